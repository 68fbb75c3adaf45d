"""SimHash near-duplicates, found through Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hamming, link_groups, place, settle, settle_alone, take

SEED = 42
MAX_BITS = 4
#: (shift, bits) of the three fingerprint segments; the last is padded with zeros to the code's 23 bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Neighbours by fingerprint order within a key that a fingerprint is compared with at once.
REACH = 7
#: (shift, bits) of three blocks of a segment.
BLOCKS = ((0, 8), (8, 8), (16, 7))
#: (shift, bits) of six blocks of a fingerprint.
SIXTHS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
GENERATOR = 0b101011100011  # of the binary Golay code [23, 12, 7]


def fingerprint(data: bytes, size: int = 4) -> int:
    """SimHash over word shingles, repeats included; ``data`` is UTF-8. Bit i is 1 if over half the shingle hashes have it."""
    words = data.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    if len(words) <= size:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = list(zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), 1 << 16):
        part = spans[at : at + (1 << 16)]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``(doc_id, fp long)`` for each row; a null text counts as empty, which has fingerprint zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = take(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By 11-bit syndrome: the error pattern of least weight, and all patterns of weight up to 4 (padded with -1)."""
    syndrome_of_bit = []
    for bit in range(23):
        word = 1 << bit
        for high in range(22, 10, -1):
            if word >> high & 1:
                word ^= GENERATOR << (high - 11)
        syndrome_of_bit.append(word)
    by_syndrome: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = pattern = 0
            for bit in bits:
                syndrome ^= syndrome_of_bit[bit]
                pattern |= 1 << bit
            by_syndrome[syndrome].append(pattern)
    near = np.full((1 << 11, max(map(len, by_syndrome))), -1, np.int64)
    for s, patterns in enumerate(by_syndrome):
        near[s, : len(patterns)] = patterns
    return near[:, 0].copy(), near


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a 23-bit word, as tables."""
    value = np.arange(1 << 12, dtype=np.int64)

    def reduce(word):
        for high in range(22, 10, -1):
            word = np.where(word >> high & 1, word ^ (GENERATOR << (high - 11)), word)
        return word

    return reduce(value), reduce(value[: 1 << 11] << 12)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: any two fingerprints that differ in at most four bits share a key.

    Each segment decodes to the index of its nearest codeword (at most 3 bits away) and to those of all codewords
    within 4. Of at most four wrong bits in three segments, either two segments have at most one each: then the nearest
    codeword of one fingerprint is among the near ones of the other, in both segments, and a key pairs the nearest index
    in one segment with a near index in the other. Or the errors are 2, 2 and 0: then one whole segment is equal, and so
    is one of three blocks of another; a key pairs the segment with the block.
    """
    nearest_error, near_errors = golay()
    low, high = _syndromes()
    rows = np.arange(len(fps), dtype=np.int64)
    segments, nearest, near = [], [], []
    for shift, bits in SEGMENTS:
        value = ((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = low[value & 0xFFF] ^ high[value >> 12]
        errors = near_errors[syndrome]
        segments.append(value)
        nearest.append((value ^ nearest_error[syndrome]) >> 11)
        near.append(np.where(errors < 0, -1, (value[:, None] ^ errors) >> 11))
    out_rows, out_keys = [], []
    for pair, (s, t) in enumerate(combinations(range(3), 2)):
        for first, second in ((nearest[s][:, None], near[t]), (near[s], nearest[t][:, None])):
            keys = np.where((first < 0) | (second < 0), -1, (pair << 24) | (first << 12) | second)
            if first.shape[1] > 1:
                keys[:, 0] = -1  # both nearest: the other side has this key already
            kept = keys >= 0
            out_rows.append(np.broadcast_to(rows[:, None], keys.shape)[kept])
            out_keys.append(keys[kept])
    for s, value in enumerate(segments):
        other = segments[1 if s == 0 else 0]
        for b, (shift, bits) in enumerate(BLOCKS):
            out_rows.append(rows)
            out_keys.append(((3 + 3 * s + b) << 32) | (value << 8) | (other >> shift & ((1 << bits) - 1)))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for at in range(0, len(ids), 4096):
                rows, keys = fuzzy_keys(fps[at : at + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[at : at + 4096][rows]), pa.array(fps[at : at + 4096][rows])], ["key", "id", "fp"])

    return nodes.mapInArrow(run, "key long, id long, fp long")


def untouched(fp: Column) -> tuple[Column, Column]:
    """Two of six blocks of a fingerprint, in all fifteen ways: four wrong bits leave two of them as they are."""
    part = lambda shift, bits: F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))
    pairs = F.array(*(F.lit(n << 22).cast("long").bitwiseOR(F.shiftleft(part(*a), 11)).bitwiseOR(part(*b)) for n, (a, b) in enumerate(combinations(SIXTHS, 2))))
    return pairs, pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``(doc_id, fp long, component_id)`` for each row of ``docs``.

    Two documents link if their fingerprints differ in at most four bits; ``component_id`` is the smallest id that is
    reachable. Equal fingerprints form one class, whose smallest id stands for it, so copies cost nothing further.
    Repeated rows give repeated rows. A row without an id links to nothing and has a null component. Null, empty and
    white texts have fingerprint zero and link like any other. Texts of any length are read whole. No rows give no rows.
    """
    marked = settle(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = settle(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")).select("id", "fp"), "classes")
    parts = settle_alone(lambda: link_groups(_keyed(classes), lambda a, b: hamming(a, b) <= MAX_BITS, untouched, reach=REACH, alone=True), "parts")
    named = classes.join(parts, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = marked.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate group; rows without an id stay.

    Of rows that repeat an id only their number is kept: all of them stay if the id does.
    """
    groups = near_duplicates(docs, id_col, text_col)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    keep = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    at = place(docs.columns, id_col)
    return keep.join(gone, F.col(f"_in{at}") == F.col("_gone"), "left_anti").toDF(*docs.columns)
