"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so the sketches are of the items. Items are partitioned by their number of
shingles n; an item of size n is sketched by its ``n - ceil(0.8 n) + 1`` least shingle hashes (a bottom-k MinHash with k
by size). A text that holds at least 0.8 of an item's shingles holds one of any such subset, so probing a document's
shingles against the sketches loses nothing, whatever the document's size. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle, take

SIZE = 5
CONTAINMENT = 0.8
#: Rows of (id, id) or (hash, id) up to which a side is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(items: Column, size: int, of) -> Column:
    """``of`` each run of ``size`` items, of the whole array if it is shorter, of nothing if it is empty."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items) - (size - 1), F.lit(1)))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: of(F.slice(items, i, size)))).otherwise(F.array().cast("array<long>") if of is F.xxhash64 else F.array().cast("array<string>"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= rows else df


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_matched, n_shingles, containment)`` for each document that holds at least ``containment`` of a test item's shingles.

    Shingles are runs of five words, sets on both sides; a text of fewer words is one shingle. Null and empty texts hold
    none, and an item without shingles matches nothing. Repeated items of one id count as one item for each different
    text; rows that repeat an id, null among them, are searched one by one and the best match is reported once.
    """
    own = take(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tests = take(items, item_id=item_col, text=item_text_col).where("text is not null").distinct()
    tests = tests.withColumn("w", words(F.col("text"))).select("item_id", F.array_distinct(windows(F.col("w"), size, lambda s: F.concat_ws(" ", s))).alias("shingles"), F.array_distinct(windows(F.transform("w", lambda x: F.xxhash64(x)), size, F.xxhash64)).alias("hashes"))
    tests = settle(tests.where(F.size("shingles") > 0).withColumn("test", F.xxhash64("item_id", "shingles")), "items")
    n = F.size("hashes")
    sketch = tests.select("test", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), n - F.ceil(n * containment - 1e-9).cast("int") + 1)).alias("hash"))

    hashed = own.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    probes = hashed.select("doc_id", F.explode(windows(F.col("w"), size, F.xxhash64)).alias("hash"))
    pairs = settle(probes.join(small(sketch), "hash").select("doc_id", "test").distinct(), "candidates")

    found = own.join(small(pairs).withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
    found = found.select("doc_id", "test", words(F.col("text")).alias("w"))
    found = found.select("doc_id", "test", windows(F.col("w"), size, lambda s: F.concat_ws(" ", s)).alias("has"))
    checked = found.join(small(tests.select("test", "item_id", "shingles"), 20_000), "test")
    checked = checked.select("doc_id", "item_id", F.size(F.array_intersect("shingles", "has")).cast("long").alias("n_matched"), F.size("shingles").cast("long").alias("n_shingles"))
    checked = checked.withColumn("containment", F.col("n_matched") / F.col("n_shingles")).where(F.col("containment") >= containment - 1e-12)
    best = F.max(F.struct("containment", "n_matched", "n_shingles")).alias("best")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_matched", "best.n_shingles", "best.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is not among the contaminated ones; other ids all stay."""
    gone = small(settle(contaminated(docs, items, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_gone")).distinct(), "contaminated"))
    keep = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    return keep.join(gone, F.col(f"_in{docs.columns.index(id_col)}").cast("long").eqNullSafe(F.col("_gone")), "left_anti").toDF(*docs.columns)
