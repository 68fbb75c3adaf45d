import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, simhash
from tessera.llm.simhash import MAX_BITS, drop_near_duplicates, fingerprint, fuzzy_keys, golay, near_duplicates


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs):
    fps = [(i, plain_fingerprint(t or "")) for i, t in docs]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= MAX_BITS:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(fps):
        low[find(k)] = min(i, low.get(find(k), i))
    return {(i, fp, low[find(k)]) for k, (i, fp) in enumerate(fps)}


def test_fingerprint_matches_its_definition():
    rng = random.Random(0)
    words = ["the", "Of", "Ünder", "x1", "ÉTÉ", "日本", "a b", "zz"]
    for n in (0, 1, 2, 3, 4, 5, 30, 200):
        text = rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(n))
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_golay_code_has_distance_seven():
    nearest, near = golay()
    assert all(int(e).bit_count() <= 3 for e in nearest) and len(set(nearest.tolist())) == 2048
    assert max(int(x).bit_count() for x in near.ravel() if x >= 0) == 4


def test_all_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        bits = rng.choice(64, rng.integers(0, 5), replace=False) if i % 2 else np.concatenate([rng.choice(23, 2, replace=False), 23 + rng.choice(23, 2, replace=False)])
        for bit in bits:
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [set(zip(*(x.tolist() for x in fuzzy_keys(v)), strict=True)) for v in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(a)))


def test_components_match_brute_force(spark, documents):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 40, 300]))] for _ in range(40)]
    docs = [" ".join(w) for w in base]
    for w in base[:30]:
        for _ in range(4):  # near copies of copies, so that groups are chains
            w = w[:]
            w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    docs += [docs[0]] * 5 + [None, "", " \n", "one", "One"]
    rng.shuffle(docs)
    found = near_duplicates(documents(docs).repartition(5)).collect()
    assert {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found} == plain_components(list(enumerate(docs)))


def test_odd_inputs(spark, documents):
    assert near_duplicates(documents([])).count() == 0
    rows = documents([(3, "a b"), (3, "a b"), (None, "a b"), (1, "a b"), (2, "x" * 100_000)]).select("*", F.lit(1).alias("fp"), F.lit("x").alias("component_id"), F.lit("clash").alias("Text"))
    out = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(rows).collect()), key=str)
    assert out == sorted([(3, 1), (3, 1), (None, None), (1, 1), (2, 2)], key=str)
    kept = drop_near_duplicates(documents([(3, "a b"), (1, "a b"), (None, "a b"), (2, "c d")]))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, None] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def crowd(rng, n):
    """Different fingerprints that are one but for three to eight bits of the low 46: many keys have many of them."""
    base, out = rng.getrandbits(64), set()
    while len(out) < n:
        fp = base
        for bit in rng.sample(range(46), rng.randint(3, 8)):
            fp ^= 1 << bit
        out.add(fp)
    return sorted(out)


def test_nodes_of_crowded_keys_are_divided_once(spark, monkeypatch):
    fps = crowd(random.Random(11), 600)
    marked = spark.createDataFrame([(i, fp - (1 << 64) * (fp >> 63)) for i, fp in enumerate(fps)], "doc_id long, fp long")
    divided, plain = [], common.settle

    def counted(df, label="step"):
        out = plain(df, label)
        if label == "mixed":
            divided.append((out.count(), out.select("id").distinct().count()))
        return out

    monkeypatch.setattr(common, "settle", counted)
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: marked)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(marked.withColumn("text", F.lit(""))).collect()}
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= MAX_BITS:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert found == {i: find(i) for i in range(len(fps))}
    assert divided and all(rows == ids for rows, ids in divided)


def test_fingerprints_within_four_bits_share_a_division(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(500):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append((a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)))
    df = spark.createDataFrame(pairs, "a long, b long")
    under, look = simhash.untouched(F.col("a"))[0], simhash.untouched(F.col("b"))[1]
    assert df.where(~F.arrays_overlap(under, look)).count() == 0
