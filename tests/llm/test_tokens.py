import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, token_files, tokens
from tessera.llm.rollups import TokenRollup, count_tokens
from tessera.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world! It's 12½ o'clock; DON'T we'll  go\n\n there \t.", "Éçole naïve über ß ª º ² ŉ ſ İstanbul", "日本語 text 🎉 é", "a b c\x85d\x1cend", "<|endoftext|> is text", "", " ", "x" * 5000, "'s 't're'", "१२ ٣ Ⅷ", "a­b\x00c", "  lead and trail  ",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    encode, rng = Encoder(path), random.Random(1)
    pieces = ["The", "of", " ", "\n", "'", "é", "Ü", "3", "!", "½", "\t", "ªº", "²", "don't", "  "]
    for text in TEXTS + ["".join(rng.choice(pieces) for _ in range(60)) for _ in range(300)]:
        assert encode(text) == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert encode(None) == b""


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_many_texts_at_once_and_a_small_memo(path, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 20)
    monkeypatch.setattr(tokens, "GROUP", 200)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(2)
    texts = TEXTS + [" ".join("".join(rng.choice("abcé1'.") for _ in range(rng.randint(1, 70))) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None]
    wanted = [np.asarray(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(Encoder(path).each(texts)) == wanted


def test_new_pre_tokens_of_the_byte_layout_go_to_the_model(monkeypatch):
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    rng, plain_characters = random.Random(4), tokens._PLAIN
    texts = ["".join(rng.choice(plain_characters + 40 * " " + 9 * "'\n") for _ in range(400)).replace("<|", "") for _ in range(300)]
    wanted = [np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    encode, through = Encoder(BYTE), []

    class Counted:
        def __getattr__(self, name):
            through.append(name)
            return getattr(plain, name)

    encode.tokenizer = Counted()
    assert list(encode.each(texts)) == wanted
    assert not through  # neither the whole text's nor a pre-token's way through normaliser and splitter


def test_new_pre_tokens_of_the_word_layout_go_to_the_model():
    plain = Tokenizer.from_file(WORD)
    plain.encode_special_tokens = True
    rng, plain_characters = random.Random(5), tokens._PLAIN
    texts = ["".join(rng.choice(plain_characters + 40 * " " + 9 * "'\n") for _ in range(400)).replace("<|", "") for _ in range(300)]
    wanted = [np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    encode = Encoder(WORD)
    encode.tokenizer = None  # neither the whole text's nor a pre-token's way through normaliser and splitter
    assert list(encode.each(texts)) == wanted


def reference(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_files_round_trip(spark, documents, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(-4, None), (7, "again"), (7, "again"), (1 << 40, "far")]
    random.Random(2).shuffle(rows)
    files = token_files.write(documents(rows).repartition(3), f"file://{tmp_path}/t", WORD, 1)
    assert token_files.open_files(f"file://{tmp_path}/t") == files
    found = sorted(tuple(r) for r in token_files.read(spark, files).collect())
    expected, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = reference(WORD, text, 1)
        expected.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == sorted(expected) and files.n_tokens == start
    none = token_files.write(documents([]), f"file://{tmp_path}/none", WORD, 1)
    assert none.n_tokens == 0 and token_files.read(spark, none).count() == 0
    nameless = token_files.write(documents([(None, "a"), (0, "b")]), f"file://{tmp_path}/null", WORD, 1)
    assert {r["doc_id"] for r in token_files.read(spark, nameless).collect()} == {None, 0}


def test_plan_is_whole_and_tight():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randrange(5, 60)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        bins = packing.plan(counts, capacity)
        placed = {}
        for items, many in bins:
            assert sum(n * k for n, k in items) <= capacity
            for n, k in items:
                placed[n] = placed.get(n, 0) + k * many
        assert placed == counts
        large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
        least = max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))
        used = sum(many for _, many in bins)
        assert least <= used <= max(least * 11 / 9 + 1, len(large))
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_packing(spark, documents):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "stone", "x1"]) for _ in range(rng.choice([0, 1, 5, 60, 90]))) for _ in range(80)] + [None, "", "y"]
    capacity = 32
    out = packing.pack(documents(texts).repartition(4), BYTE, capacity, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        rows = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist()
        assert ids == reference(BYTE, text, 0)
        assert all(r["length"] == capacity for r in rows[1:]) and [r["start"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))]
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert len(by_sequence) <= 1.02 * -(-sum(r["length"] for r in out) // capacity) + 1
    assert packing.pack(documents([]), BYTE).count() == 0
    assert packing.pack(documents([(None, "a"), (1, "b"), (1, "b")]).withColumn("length", F.lit("clash")).withColumn("rank", F.lit(0)), BYTE).count() == 3


def test_rollups(spark, documents, tmp_path):
    docs = documents([(1, "one two"), (2, None), (3, "three"), (None, "nobody"), (4, "four")]).withColumn("lang", F.when(F.col("doc_id") == 4, None).otherwise(F.col("lang")))
    counts = count_tokens(docs, BYTE, "v1")
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    get = lambda: {(r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert rollup.commit("load", upserts=counts) and get() == {("en", "v1"): (3, 3), (None, "v1"): (1, 1)}
    assert not rollup.commit("load", upserts=counts) and not rollup.commit("load", deletes=docs)
    rollup.commit("same", upserts=counts)
    assert get() == {("en", "v1"): (3, 3), (None, "v1"): (1, 1)}
    revised = spark.createDataFrame([(1, "s", "de", "v1", 9), (1, "s", "de", "v1", 8), (3, "s", "en", "v2", 5)], "doc_id long, source string, lang string, version string, n_tokens long")
    rollup.commit("revise", upserts=revised)
    assert get() == {("en", "v1"): (2, 1), (None, "v1"): (1, 1), ("de", "v1"): (1, 9), ("en", "v2"): (1, 5)}
    rollup.commit("gone", deletes=spark.createDataFrame([(3, None), (4, "v2"), (99, None)], "doc_id long, version string"))
    assert get() == {("en", "v1"): (1, 0), (None, "v1"): (1, 1), ("de", "v1"): (1, 9)}
    again = TokenRollup(spark, f"file://{tmp_path}/r")
    state = {(r["doc_id"], r["version"], r["n_tokens"]) for r in again.state().collect()}
    assert state == {(1, "v1", 9), (2, "v1", 0), (4, "v1", 1)} and set(again.committed()) == {"load", "same", "revise", "gone"}
    with pytest.raises(ValueError):
        rollup.commit("../x")
    rollup.commit("void", upserts=counts.limit(0), deletes=docs.limit(0))
    assert len(rollup.committed()) == 5
