"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, take

SCALE = 1024
#: Queries that are scored together; their vectors are what a task gets besides its own candidates.
QUERY_BLOCK = 1024
#: Bins of one refinement step, and candidates beyond k that end the refinement.
BINS = 1024
SLACK = 256
#: Candidates that a task scores at once.
ROWS = 2048
_MOST = np.iinfo(np.int64).max


def quantised(batch: pa.RecordBatch, scale: int = SCALE):
    """Yields ``(ids, matrix of float64 whole numbers)`` for each dimension among the valid vectors of a batch (id, embedding)."""
    ids, vectors = batch.column(0), batch.column(1).to_pylist()
    by_dim: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids.to_pylist(), vectors, strict=True):
        if i is not None and v is not None and len(v) and None not in v:
            own, rows = by_dim.setdefault(len(v), ([], []))
            own.append(i)
            rows.append(v)
    for own, rows in by_dim.values():
        m = np.asarray(rows, np.float64)
        fine = np.isfinite(m).all(axis=1)
        with np.errstate(over="ignore"):
            yield np.asarray(own, np.int64)[fine], np.floor(scale * m[fine])


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; values beyond a signed 64-bit integer are held at its bounds."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(x) if np.isfinite(x) else 0 for x in r] for r in queries], object) @ np.array([[int(x) if np.isfinite(x) else 0 for x in r] for r in rows], object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def scored(batches, block, scale):
    """Yields ``(query positions, candidate ids, scores, which take part)`` for each part of a task's candidates."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for ids, rows in quantised(batch.slice(at, ROWS), scale):
                for positions, query_ids, queries in block:
                    if len(ids) and queries.shape[1] == rows.shape[1]:
                        yield positions, ids, products(queries, rows), query_ids[:, None] != ids[None, :]


def _block(rows, scale):
    """The block by dimension: positions, ids, matrix."""
    batch = pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.int64()), pa.array([list(r["embedding"]) for r in rows], pa.list_(pa.float64()))], ["id", "embedding"])
    out, at = [], 0
    for ids, m in quantised(batch, scale):
        out.append((np.arange(at, at + len(ids)), ids, m))
        at += len(ids)
    return out, at


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` largest integer inner products, ties to smaller ids.

    Components become ``floor(scale * x)``. Each block of queries is scored against all candidates: a first pass takes
    each query's range of scores, further passes count scores in bins over the range that must hold its kth value, until
    a bin is one score wide or few enough lie above it. A last pass keeps the scores from there on, at most ``k`` of a
    task's best for a query, and ranks them. Tasks hold one block of queries and one batch of candidates.

    A query is no candidate of its own, known by its id. Vectors that are null, empty or hold null or non-finite parts,
    and rows without an id, take no part; vectors of another dimension than the query's are not scored. Repeated
    candidates all count; of queries that repeat an id the least valid vector is taken. No rows give no rows.
    """
    spark = candidates.sparkSession
    rows = take(candidates, id=id_col, embedding=vector_col).select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = take(queries, id=id_col, embedding=vector_col).select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("embedding") > 0)
    asked = asked.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False))).groupBy("id").agg(F.min("embedding").alias("embedding"))
    out, last = scratch_path(spark, "topk"), None
    schema = "query_id long, rank int, vec_id long, score long"
    while found := (asked if last is None else asked.where(F.col("id") > last)).orderBy("id").limit(QUERY_BLOCK).collect():
        last = found[-1]["id"]
        block, n = _block(found, scale)
        if n:
            _one_block(rows, block, n, k, scale).write.mode("append").parquet(out)
    if last is None or not _exists(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def _exists(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _one_block(rows: DataFrame, block, n: int, k: int, scale: int) -> DataFrame:
    def ranges(batches):
        low, high, count = np.full(n, _MOST), np.full(n, -_MOST), np.zeros(n, np.int64)
        for at, _, scores, own in scored(batches, block, scale):
            low[at] = np.minimum(low[at], np.where(own, scores, _MOST).min(axis=1))
            high[at] = np.maximum(high[at], np.where(own, scores, -_MOST).max(axis=1))
            count[at] += own.sum(axis=1)
        q = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(low[q]), pa.array(high[q]), pa.array(count[q])], ["q", "low", "high", "n"])

    # A query's kth largest score lies in [low, high]; `above` scores are larger than high.
    low, high, above, total = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in rows.mapInArrow(ranges, "q long, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        low[r["q"]], high[r["q"]], total[r["q"]] = r["low"], r["high"], r["n"]
    inside = total.copy()
    while len(open_ := np.flatnonzero((total > k) & (high > low) & (above + inside > k + SLACK))):
        width = np.ones(n, np.int64)
        width[open_] = [-((int(low[i]) - int(high[i]) - 1) // BINS) for i in open_]
        todo, floor, top = np.isin(np.arange(n), open_), low.copy(), high.copy()

        def bins(batches, width=width, todo=todo, floor=floor, top=top):
            counts = np.zeros((n, BINS), np.int64)
            for at, _, scores, own in scored(batches, block, scale):
                take_ = own & todo[at, None] & (scores >= floor[at, None]) & (scores <= top[at, None])
                r, c = np.nonzero(take_)
                np.add.at(counts, (at[r], (scores[r, c] - floor[at[r]]) // width[at[r]]), 1)
            q, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["q", "bin", "n"])

        from_top = W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
        summed = rows.mapInArrow(bins, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above_at = spark_map(summed.sparkSession, above, open_)
        run = summed.withColumn("sofar", F.sum("n").over(from_top)).join(F.broadcast(above_at), "q").where((F.col("sofar") + F.col("above") >= k) & (F.col("sofar") - F.col("n") + F.col("above") < k))
        for r in run.collect():  # one bin for each query of the block
            q = r["q"]
            low[q], high[q] = floor[q] + r["bin"] * width[q], min(int(top[q]), int(floor[q] + (r["bin"] + 1) * width[q] - 1))
            above[q], inside[q] = above[q] + r["sofar"] - r["n"], r["n"]

    least = low

    def best(batches):
        kept: dict[int, list[tuple[int, int]]] = {}
        for at, ids, scores, own in scored(batches, block, scale):
            r, c = np.nonzero(own & (scores >= least[at, None]))
            order = np.lexsort((ids[c], -scores[r, c], r))
            r, c = r[order], c[order]
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
            for a in starts:
                b = min(a + k, np.searchsorted(r, r[a], "right"))
                have = kept.setdefault(int(at[r[a]]), [])
                have += zip((-scores[r[a:b], c[a:b]]).tolist(), ids[c[a:b]].tolist(), strict=True)
                have.sort()
                del have[k:]
        out = [(int(query_ids[q]), i, -s) for q, have in kept.items() for s, i in have]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    query_ids = np.concatenate([ids for _, ids, _ in block])
    ranked = rows.mapInArrow(best, "query_id long, vec_id long, score long")
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def spark_map(spark, values, keys) -> DataFrame:
    """``(q, above)`` of one block of queries."""
    return spark.createDataFrame([(int(q), int(values[q])) for q in keys], "q long, above long")
