"""The registered queries of this subpackage: thin contracts over the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, table


def _line_dedup(spark, sf_dir):
    from tessera.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def _packing(spark, sf_dir):
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _toxicity(spark, sf_dir):
    from tessera.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def _token_files(spark, sf_dir):
    from tessera.llm.token_files import read, write

    return read(spark, write(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def _decontamination(spark, sf_dir):
    from tessera.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _top_k(spark, sf_dir):
    from tessera.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def _simhash(spark, sf_dir):
    from tessera.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _secrets(spark, sf_dir):
    from tessera.llm.secrets import scan

    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_confirmed")


def _extraction(spark, sf_dir):
    from tessera.llm.extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def _rollups(spark, sf_dir):
    """Loads all counts, deletes exact copies, revises counts to include an end token, and repeats a batch in vain."""
    from tessera.llm.common import settle
    from tessera.llm.rollups import TokenRollup, count_tokens

    docs = table(spark, sf_dir, "documents")
    counts = settle(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k"), "counts")
    words = docs.select("doc_id", "source", "lang", F.lit("words").alias("version"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long").alias("n_tokens"))
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("load", upserts=counts.unionByName(words))
    alike = docs.select("doc_id", F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), F.length("text").alias("n"))
    first = alike.groupBy("h", "c", "n").agg(F.min("doc_id").alias("first"))
    copies = settle(alike.join(first, ["h", "c", "n"]).where("doc_id <> first").select("doc_id"), "copies")
    rollup.commit("copies", deletes=copies)
    ended = rollup.state().where("version = 'byte_bpe_50k'").withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup.commit("end-token", upserts=ended)
    rollup.commit("copies", deletes=copies)
    return rollup.totals()


QUERIES = {
    "op1_line_dedup": _line_dedup,
    "op2_best_fit_packing": _packing,
    "op3_toxicity": _toxicity,
    "op4_token_files": _token_files,
    "op5_decontamination": _decontamination,
    "op6_exact_top_k": _top_k,
    "op7_simhash_near_dedup": _simhash,
    "op8_secret_scan": _secrets,
    "op9_html_extraction": _extraction,
    "op10_token_counts": _rollups,
}

_SHINGLES = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"""
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

#: Brute force in SQL, where SQL has what it takes; tests/llm has brute force for the others.
ORACLES: dict[str, str] = {
    "op5_decontamination": f"""
        WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        ds AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM dw), bs AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM iw),
        n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS n_matched FROM ds JOIN bs ON ds.s = bs.s GROUP BY 1, 2)
        SELECT doc_id, m.item_id, n_matched, n_shingles, n_matched / n_shingles AS containment FROM m JOIN n ON m.item_id = n.item_id WHERE n_matched >= 0.8 * n_shingles""",
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 10""",
}
