"""Token-id files: flat unsigned integers with 64-bit document offsets, written in id order and memory-mapped back."""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import settle, take

#: Documents that a reader hands on at once.
READ_ROWS = 4096


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are and what each shard holds: ``shards`` has (name, first document, first token, documents, tokens)."""

    path: str
    width: int
    shards: tuple[tuple[str, int, int, int, int], ...]

    @property
    def n_tokens(self) -> int:
        return sum(s[4] for s in self.shards)


def _store(path: str):
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes each whole text, appends ``end_id`` and writes shards into ``path`` (a URI all executors reach).

    Shard ``s`` is two files. ``s.bin`` holds the ids of its documents one after another, little-endian, 16 bits wide
    if the vocabulary allows and else 32. ``s.idx`` holds n, then n ids (int64), n flags for null ids (uint8), and n + 1
    offsets (uint64) into ``s.bin``, in tokens. Shards are in ascending id order, nulls first, equal ids by text;
    ``manifest.json`` gives each shard's base, the sum of all shards before it. Null texts count as empty.
    An attempt writes under a name of its own and only reported shards count, so repeated tasks do no harm.
    """
    spark = docs.sparkSession
    store, root = _store(path)
    store.create_dir(root, recursive=True)

    def run(batches):
        from tessera.llm.tokens import encoder

        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        width = 2 if max(encode.vocab - 1, end_id) < 1 << 16 else 4
        out, at = _store(path)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        ids, nulls, sizes, sink = [], [], [], None
        for batch in batches:
            if sink is None and batch.num_rows:
                sink = out.open_output_stream(f"{at}/{name}.bin")
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            for found in encode.each(batch.column(1).to_pylist()):
                tokens = np.frombuffer(found + end, "<u4")
                sizes.append(len(tokens))
                sink.write(tokens.astype(f"<u{width}").tobytes())
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.uint64))).astype("<u8")
        with out.open_output_stream(f"{at}/{name}.idx") as f:
            f.write(np.array([len(sizes)], "<u8").tobytes() + np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes() + offsets.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "width": [width], "n_docs": [len(sizes)], "n_tokens": [int(offsets[-1])]}, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = take(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sharded = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    report = settle(sharded.mapInArrow(run, "shard int, name string, width int, n_docs long, n_tokens long"), "shards")
    shards, docs_before, tokens_before, width = [], 0, 0, 4
    for row in report.orderBy("shard").collect():  # a row for each shard
        shards.append((row["name"], docs_before, tokens_before, row["n_docs"], row["n_tokens"]))
        docs_before, tokens_before, width = docs_before + row["n_docs"], tokens_before + row["n_tokens"], row["width"]
    out = TokenFiles(path, width, tuple(shards))
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": width, "shards": [dict(zip(("name", "first_doc", "first_token", "n_docs", "n_tokens"), s, strict=True)) for s in shards]}).encode())
    return out


def open_files(path: str) -> TokenFiles:
    """The files that ``write`` left in ``path``."""
    store, root = _store(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        found = json.loads(f.read())
    return TokenFiles(path, found["width"], tuple((s["name"], s["first_doc"], s["first_token"], s["n_docs"], s["n_tokens"]) for s in found["shards"]))


def _mapped(store, path: str, kind: str) -> np.ndarray:
    """The file as an array: mapped where it is local, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.empty(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def shard_arrays(store, root: str, name: str, width: int):
    """Ids, null flags, offsets and tokens of a shard."""
    raw = _mapped(store, f"{root}/{name}.idx", "u1")
    n = int(raw[:8].view("<u8")[0])
    ids, nulls = raw[8 : 8 + 8 * n].view("<i8"), raw[8 + 8 * n : 8 + 9 * n]
    offsets = np.frombuffer(raw[8 + 9 * n :].tobytes(), "<u8")
    return ids, nulls.astype(bool), offsets, _mapped(store, f"{root}/{name}.bin", f"<u{width}")


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """From the files: ``(doc_id, start, n_tokens, ids_crc32)`` for each document, in the layout of op4's contract."""
    path, width = files.path, files.width

    def run(batches):
        store, root = _store(path)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, nulls, offsets, tokens = shard_arrays(store, root, name, width)
                for at in range(0, len(ids), READ_ROWS):
                    part = slice(at, min(at + READ_ROWS, len(ids)))
                    a, b = offsets[part], offsets[part.start + 1 : part.stop + 1]
                    sums = [zlib.crc32(tokens[int(x) : int(y)].astype("<u4").tobytes()) for x, y in zip(a, b, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part], mask=nulls[part]), pa.array(a.astype(np.int64) + base), pa.array((b - a).astype(np.int64)), pa.array(sums, pa.int64())], schema=schema)

    shards = spark.createDataFrame([(s[0], s[2]) for s in files.shards], "name string, base long")
    return shards.repartition(max(1, len(files.shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
