"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import place, take

SIZES = (3, 4, 5, 6)
BITS = 18
#: Features that the linear model sees by default: those whose document frequencies differ most between the classes.
FEATURES = 4096
#: At most so many labelled rows fit the linear weights; the log-count ratios count all labelled rows.
FIT_ROWS = 20_000
L2 = 1e-3
STEPS = 300
RATE = 0.05
THRESHOLD = 0.3
#: Characters of a text that are hashed at once.
CHUNK = 1 << 20
#: Labels that are broadcast to the documents after a count; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

_NOT_WORD = re.compile(r"[\W_]+")


def grams(text: str | None):
    """Yields arrays of hashed n-grams of the lower-cased text, words apart by one space; all n-grams of the whole text."""
    clean = f" {_NOT_WORD.sub(' ', text.lower()).strip()} " if text else " "
    for at in range(0, len(clean), CHUNK):
        points = np.frombuffer(clean[at : at + CHUNK + max(SIZES) - 1].encode("utf-32-le"), np.uint32)
        for n in SIZES:
            many = min(len(points) - n + 1, CHUNK)
            if many > 0:
                h = np.full(many, n, np.uint32)
                for j in range(n):
                    h = h * np.uint32(16777619) ^ points[j : j + many]
                yield (h * np.uint32(2654435769)) >> np.uint32(32 - BITS)


def present(text: str | None, flags: np.ndarray) -> np.ndarray:
    """The different n-grams of ``text``, ascending; ``flags`` is scratch of ``1 << BITS`` zeros."""
    for h in grams(text):
        flags[h] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


@dataclass(frozen=True)
class Model:
    """``slot`` maps an n-gram to its feature or -1; ``weight`` is the linear weight times the log-count ratio."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = [s[s >= 0] for s in (self.slot[h] for h in grams(text))]
        total = self.bias + (float(self.weight[np.unique(np.concatenate(found))].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))


def held_out(id_col: str) -> Column:
    """The rows whose labels are never learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, label)`` of the rows to learn from: labelled and not held out. Of several labels the largest counts."""
    marks = take(labels, doc_id=id_col, label=label_col).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    return take(docs, doc_id=id_col, text=text_col).join(marks, "doc_id").select("doc_id", F.col("text").cast("string"), "label")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", features: int = FEATURES, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the labelled rows that are not held out.

    Document frequencies of all n-grams are counted over all of them, on the executors. The driver gets the counts (at
    most ``1 << BITS`` rows) and, for about 0.95 ``fit_rows`` rows chosen by a hash of the id, which of the ``features``
    (32767 at most) features they have, as 16-bit numbers. Without rows of both classes the model is the smoothed share
    of label 1.
    """
    rows = labelled(docs, labels, label_col, id_col, text_col)

    def count(batches):
        flags, counts, n = np.zeros(1 << BITS, bool), np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(label == 1), present(text, flags)] += 1
                n[int(label == 1)] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[n[0], counts[0, used]]), pa.array(np.r_[n[1], counts[1, used]])], ["gram", "zeros", "ones"])

    summed = rows.select("text", "label").mapInArrow(count, "gram long, zeros long, ones long").groupBy("gram").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    gram, zeros, ones = (summed.column(c).to_numpy() for c in ("gram", "zeros", "ones"))
    n0, n1 = int(zeros[gram < 0].sum()), int(ones[gram < 0].sum())
    slot = np.full(1 << BITS, -1, np.int16)
    if not n0 or not n1:
        return Model(slot, np.zeros(1), float(np.log((n1 + 1) / (n0 + 1))))
    gram, zeros, ones = gram[gram >= 0], zeros[gram >= 0], ones[gram >= 0]
    ratio = np.log((ones + 1) / (n1 + 2)) - np.log((zeros + 1) / (n0 + 2))
    pool = (ones + zeros) / (n0 + n1)
    apart = np.abs(ones / n1 - zeros / n0) / np.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0) + 1e-12)
    chosen = np.lexsort((gram, -apart))[:features]
    slot[gram[chosen]] = np.arange(len(chosen))
    ratio = ratio[chosen]

    share = min(1.0, 0.95 * fit_rows / (n0 + n1)) if n0 + n1 > fit_rows else 1.0
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text", "label")

    def found(batches):
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            has = [np.sort((s := slot[present(t, flags)])[s >= 0]).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(has, pa.binary())], ["label", "features"])

    sample = picked.mapInArrow(found, "label int, features binary").toArrow()
    rows_ = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist(), strict=True))  # whatever the order of tasks
    del sample, summed
    pa.default_memory_pool().release_unused()
    weight, bias = fit([np.frombuffer(f, np.int16) for _, f in rows_], np.array([label for label, _ in rows_]), ratio)
    return Model(slot, weight, bias)


def fit(features: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on the scaled features, by Adam on all rows: ``(weight * ratio, bias)``.

    ``features`` are 16-bit numbers and stay so; ``block`` of them at a time are looked at in each step.
    """
    y = (labels == 1).astype(float)
    sizes = np.array([len(f) for f in features], np.int64)
    col = np.concatenate([*features, np.empty(0, np.int16)])
    ends = np.cumsum(sizes)
    cuts = [0, *np.unique(np.searchsorted(ends, np.arange(block, ends[-1] if len(ends) else 0, block))).tolist(), len(y)]
    parts = [(a, b, slice(int(ends[a] - sizes[a]), int(ends[b - 1]))) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    theta = np.zeros(len(ratio) + 1)
    theta[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        slope = np.append(L2 * theta[:-1], 0.0)
        scaled = ratio * theta[:-1]
        for a, b, at in parts:
            c, row = col[at].astype(np.intp), np.repeat(np.arange(b - a), sizes[a:b])
            z = np.bincount(row, scaled[c], b - a) + theta[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y[a:b]) / len(y)
            slope[:-1] += np.bincount(c, error[row], len(ratio)) * ratio
            slope[-1] += error.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1] * ratio, float(theta[-1])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``; the score depends on the whole text alone.

    Null and empty texts get the score of no evidence. A null id is not held out. Repeated rows are scored each.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.score(t) for t in batch.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    rows = take(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""

    @F.pandas_udf("double")
    def of(texts):
        return texts.map(model.score)

    keep = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    return keep.where(of(F.col(f"_in{place(docs.columns, text_col)}").cast("string")) < threshold).toDF(*docs.columns)
