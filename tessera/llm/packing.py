"""Best-fit packing of documents into fixed-length sequences, by counts of lengths.

How items of equal length are told apart does not matter for the number of sequences. So the plan is made on the driver
from the histogram of lengths (at most ``capacity`` numbers), and documents take their places by rank among equals,
which is a prefix sum over partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import settle, take

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins for ``counts`` items of each length: ``(((length, how many), ...), bins of this kind)``.

    Items above a third of the capacity come at most two to a bin: from the largest down, each takes the largest partner
    that still fits. Smaller items, from the largest down, go where the least room is left that holds them. Runs of equal
    items and bins are handled at once, so the work depends on the number of lengths, not of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    kinds: list[list] = []  # [items, bins]
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []  # those with bins, ascending

    def put(items: Counter, bins: int, gap: int) -> None:
        if bins:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(gaps, gap)
            by_gap[gap].append(len(kinds))
            kinds.append([items, bins])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[min(at, len(large) - 1)] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[-2] if len(large) > 1 else None
        if b is None:
            put(Counter({a: 1}), left[a], capacity - a)
            left[a] = 0
        else:
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            put(Counter((a, b)), pairs, capacity - a - b)
            left[a] -= pairs
            left[b] -= pairs
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                full = left[n] // each
                put(Counter({n: each}), full, capacity - each * n)
                rest = left[n] - full * each
                put(Counter({n: rest} if rest else {}), 1 if rest else 0, capacity - rest * n)
                left[n] = 0
                break
            gap = gaps[at]
            kind = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            items, bins = kinds[kind]
            each = min(gap // n, left[n])
            used = min(bins, left[n] // each)
            kinds[kind] = [Counter(), 0]
            put(items, bins - used, gap)
            put(items + Counter({n: each}), used, gap - each * n)
            left[n] -= each * used
    return [(tuple(sorted(items.items(), reverse=True)), bins) for items, bins in kinds if bins]


def places(planned) -> np.ndarray:
    """The plan as intervals of ranks, sorted by (length, first rank): rows of length, first rank, first bin, items a bin, offset."""
    taken: Counter = Counter()
    rows, bin_ = [], 0
    for items, bins in planned:
        offset = 0
        for n, each in items:
            rows.append((n, taken[n], bin_, each, offset))
            taken[n] += each * bins
            offset += n * each
        bin_ += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, nth[, ids])``: documents as token ids and ``end_id``, cut where longer than ``capacity``.

    All pieces but the first have the full length. ``part`` and ``nth`` give a piece's partition and its rank among that
    partition's pieces of the same length. ``ids`` are little-endian unsigned 32-bit integers.
    """

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        from tessera.llm.tokens import encoder

        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, found in zip(batch.column(0).to_pylist(), encode.each(batch.column(1).to_pylist()), strict=True):
                ids = found + end
                total = len(ids) // 4
                first = total if total <= capacity else total % capacity or capacity
                start, piece = 0, 0
                while start < total:
                    length = capacity if piece else first
                    cut = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(cut), part, seen[length], cut), strict=False):
                        column.append(value)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = take(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])`` for each piece of each row of ``docs``.

    Sequences are filled without gaps from offset 0. A null or empty text is the end id alone. Repeated rows are packed
    each for itself; a null id is kept. No rows give no rows. Equal lengths are told apart by partition and order within
    it, so which of them shares a sequence with which may differ between runs; their number may not.
    """
    cut = settle(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))
    step = 1 << 42
    firsts = table[:, 0] * step + table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(firsts, length * step + rank, "right") - 1
            within = rank - table[at, 1]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 2] + within // table[at, 3]), pa.array(table[at, 4] + within % table[at, 3] * length)], [*keep, "sequence_id", "offset"])

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = cut.join(bases, ["part", "length"]).select(*keep, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")
