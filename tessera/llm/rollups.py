"""Token counts: delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import take

KEY = ("doc_id", "version")
GROUP = ("source", "lang", "version")
LOG = "doc_id long, source string, lang string, version string, n_tokens long, sign long"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, version: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, source, lang, version, n_tokens)``: tokens of each whole text; null texts have none."""

    def run(batches):
        from tessera.llm.tokens import encoder

        encode = encoder(tokenizer_path)
        for batch in batches:
            counts = [len(ids) // 4 for ids in encode.each(batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    rows = take(docs, doc_id=id_col, source=source_col, lang=lang_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens")


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version, in a folder that all executors share.

    Each committed batch leaves a log of signed rows, one for each (document, version) that it adds or takes away, and
    their sums. The state of a document is what its signed rows add up to, and the totals are the sum of all batches'
    sums, so neither is ever rewritten and the order of batches does not matter to a sum. A batch is written under a name
    of its own first; one small file, created only if it is not there yet, then commits it. A batch id that has been
    committed does nothing; a batch that broke off before its commit has left nothing that counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = self._at(f"{self.path}/commits")
        self.store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.store.mkdirs(at)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _marker(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch_id):
            raise ValueError(f"batch id {batch_id!r} must be letters, digits, '.', '_' and '-'")
        return f"{self.path}/commits/{batch_id}.json"

    def committed(self) -> dict[str, str]:
        """Folder of each committed batch."""
        files = self.store.listStatus(self._at(f"{self.path}/commits"))
        names = [f.getPath().getName() for f in files]
        return {n.removesuffix(".json"): self._read(f"{self.path}/commits/{n}")["folder"] for n in names if n.endswith(".json")}

    def _read(self, path: str) -> dict:
        stream = self.store.open(self._at(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _parts(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{folder}/{kind}" for folder in self.committed().values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        """``(doc_id, source, lang, version, n_tokens)`` as it stands."""
        columns = ("doc_id", "source", "lang", "version", "n_tokens")
        return self._parts("log", LOG).groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*columns)

    def totals(self) -> DataFrame:
        """``(source, lang, version, n_docs, n_tokens)``; groups that have come to no documents are left out."""
        summed = self._parts("totals", TOTALS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Applies a batch once; False if it had been committed.

        ``upserts(doc_id, source, lang, version, n_tokens)`` insert documents or revise their counts, by (doc_id,
        version). ``deletes(doc_id[, version])`` take away a document's count for a version, or for all where the version
        is null or there is no such column; a batch's deletes come before its upserts. Rows without an id are ignored,
        null counts are zero, null sources, languages and versions are groups of their own. Of upserts that repeat a key
        the one with the largest count, then source, then language is taken. Deletes of what is not there do nothing.
        """
        marker = self._marker(batch_id)
        if self.store.exists(self._at(marker)):
            return False
        empty = self.spark.createDataFrame([], "doc_id long, version string")
        adds = (
            take(upserts, doc_id="doc_id", source="source", lang="lang", version="version", n_tokens="n_tokens") if upserts is not None
            else self.spark.createDataFrame([], LOG).drop("sign")
        )
        adds = adds.where("doc_id is not null").select("doc_id", "source", "lang", "version", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        best = W.partitionBy(*KEY).orderBy(*(F.desc_nulls_last(c) for c in ("n_tokens", "source", "lang")))
        adds = adds.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")
        goes = empty if deletes is None else take(deletes, doc_id="doc_id", version="version") if "version" in deletes.columns else take(deletes, doc_id="doc_id").withColumn("version", F.lit(None).cast("string"))
        goes = goes.where("doc_id is not null").select("doc_id", "version", F.col("version").isNull().alias("whole"))
        touched = goes.unionByName(adds.select("doc_id", "version", F.lit(False).alias("whole"))).groupBy("doc_id").agg(F.max("whole").alias("whole"), F.collect_set(F.coalesce(F.concat(F.lit("="), "version"), F.lit(""))).alias("versions"))
        before = self.state().join(touched, "doc_id").where(F.col("whole") | F.array_contains("versions", F.coalesce(F.concat(F.lit("="), "version"), F.lit(""))))
        signed = before.select(*adds.columns, F.lit(-1).cast("long").alias("sign")).unionByName(adds.withColumn("sign", F.lit(1).cast("long")))
        changes = signed.groupBy(*adds.columns).agg(F.sum("sign").alias("sign")).where("sign <> 0")

        folder = f"batches/{batch_id}-{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.path}/{folder}/log")
        written = self.spark.read.schema(LOG).parquet(f"{self.path}/{folder}/log")
        sums = written.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.write.parquet(f"{self.path}/{folder}/totals")
        draft = f"{self.path}/{folder}/commit.json"
        stream = self.store.create(self._at(draft), True)
        stream.write(bytearray(json.dumps({"folder": folder}).encode()))
        stream.close()
        # On stores whose rename replaces a file, two writers must not commit the same batch at the same moment.
        return bool(not self.store.exists(self._at(marker)) and self.store.rename(self._at(draft), self._at(marker)))
