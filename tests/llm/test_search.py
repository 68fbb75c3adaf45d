import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, topk
from tessera.llm.decontaminate import contaminated, drop_contaminated
from tessera.llm.line_dedup import dedup_lines, keys, marked, neighbours, once, similar_groups, strip_lines, told_apart


def plain_top(vectors, k, queries):
    q = {i: [math.floor(1024 * float(x)) for x in v] for i, v in vectors if i is not None and v and None not in v and all(map(math.isfinite, v))}
    out = set()
    for i in queries:
        if i in q:
            scored = sorted((-sum(a * b for a, b in zip(q[i], v, strict=True)), j) for j, v in q.items() if j != i and len(v) == len(q[i]))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("bins,slack,block", [(1024, 256, 1024), (4, 0, 3), (7, 2, 2)])
def test_top_k_matches_brute_force(spark, monkeypatch, bins, slack, block):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "SLACK", slack)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = random.Random(bins)
    vectors = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) if i % 3 else rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    vectors += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # ties
    vectors += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (305, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    out = topk.top_k(df.select("*", F.lit("clash").alias("rank"), F.lit(1).alias("Embedding")), df.where("vec_id % 10 = 0"), 7)
    assert {tuple(r) for r in out.collect()} == plain_top(vectors, 7, [i for i, _ in vectors if i is not None and i % 10 == 0])


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([], schema)
    assert topk.top_k(none, none).count() == 0
    few = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (2, [2.0])], schema)
    assert {tuple(r) for r in topk.top_k(few, few.where("vec_id = 1"), 10).collect()} == {(1, 1, 2, 2097152), (1, 2, 2, 2097152)}
    twice = spark.createDataFrame([(100, [float("-inf"), 1.0]), (100, [1.0, 1.0]), (100, [None, 0.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(twice, twice.where("vec_id = 100"), 10).collect()] == [(100, 1, 7, 1048576)]
    huge = topk.products(np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0], [2.0**20, 1.0]]))
    assert huge.tolist() == [[(1 << 63) - 1, (1 << 60) + 3]]


def words(rng, n, vocab):
    return [rng.choice(vocab) for _ in range(n)]


def test_containment_matches_brute_force(spark, documents):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(3000)]
    items = [" ".join(words(rng, rng.choice([3, 5, 8, 20, 50]), vocab)) for _ in range(25)] + [None, "", "Same text twice here ok", "Same text twice here ok"]
    docs = []
    for n in range(120):
        body = words(rng, rng.choice([2, 30, 400]), vocab)
        if n % 2:
            item = (items[rng.randrange(25)] or "").split()
            if n % 4 == 1 and len(item) > 10:
                item[rng.randrange(len(item))] = "changed"
            body[len(body) // 2 : len(body) // 2] = item
        docs.append(" ".join(body).upper() if n % 7 == 0 else ", ".join(body))
    docs += [None, "", items[0], "same TEXT twice here ok!"]

    def shingles(t):
        w = "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    expected = {}
    for d, t in enumerate(docs):
        for i, x in enumerate(items):
            if (s := shingles(x)) and len(s & shingles(t)) / len(s) >= 0.8:
                expected[d, i] = (len(s & shingles(t)), len(s))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("hashes", F.lit(0))
    found = contaminated(documents(docs).repartition(3).withColumn("hash", F.lit("clash")), table).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_shingles"]) for r in found} == expected
    kept = drop_contaminated(documents(docs), table)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in expected} and kept.columns == documents([]).columns
    assert contaminated(documents([]), table).count() == 0 and contaminated(documents(docs), table.limit(0)).count() == 0
    assert {r["doc_id"] for r in contaminated(documents([(None, items[3]), (5, "x"), (5, items[3])]), table).collect()} == {None, 5}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_keeps_first_occurrences(spark, documents):
    long = "a license line with quite some different words about copying software under terms"
    docs = [f"Title one\n{long}\n\nbody of one", f"title two\n  {long.upper()}  \n---\nbody of two", f"{long.replace('quite', 'rather')}\nunique\nunique\nUnique", None, "", "\n\n", f"Title one\n{long}\n\nbody of one"]
    out = {r["doc_id"]: r for r in dedup_lines(documents(docs).withColumn("gone", F.lit("clash")).withColumn("row", F.lit(1))).collect()}
    assert out[0]["text"] == docs[0] and out[0]["n_removed"] == 0 and out[0]["n_lines"] == 4
    assert out[1]["text"] == "title two\n---\nbody of two" and out[1]["n_removed"] == 1
    assert out[2]["text"].startswith("unique") or out[2]["text"].endswith("\nunique")
    assert out[2]["text"].split("\n").count("unique") == 1 and "Unique" not in out[2]["text"]
    assert out[3]["text"] is None and out[3]["n_lines"] == 0 and out[4]["text"] == "" and out[5]["text"] == "\n\n"
    assert out[6]["text"] == "" and out[6]["n_removed"] == 3 or out[6]["text"].strip() == ""
    assert dedup_lines(documents([])).count() == 0
    table = strip_lines(documents(docs))
    assert table.columns == documents([]).columns and {r["doc_id"]: r["n_chars"] for r in table.collect()}[1] == len(out[1]["text"])
    twice = dedup_lines(documents([(None, "x y"), (2, "x y"), (2, "x y"), (2, "other")])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in twice) == [("2", ""), ("2", ""), ("2", "other"), ("None", "x y")]


def test_long_lines(spark, documents):
    rng = random.Random(1)
    line = words(rng, 30_000, [f"word{i}" for i in range(5000)])
    other = line[:]
    other[7] = "changed"
    out = dedup_lines(documents([" ".join(line), " ".join(other)])).orderBy("doc_id").collect()
    assert out[0]["n_removed"] == 0 and out[1]["n_removed"] == 1


def similar(lines, found):
    """Components by brute force: the words' edit similarity alone, no fingerprints."""
    text = {i: "".join(c if c.isalnum() else " " for c in lines[at].lower()).split() for i, at in found}
    parent = {i: i for i in text}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in text:
        for b in text:
            if a < b and edit(text[a], text[b]) <= 0.2 * max(len(text[a]), len(text[b])) + 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in parent if find(i) != i or any(find(j) == i for j in parent if j != i)}


def test_line_dedup_finds_all_similar_lines(spark, documents):
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(900)] + ["of", "the", "a", "to"] * 60
    lines = []
    for n in [4, 5, 6, 9, 10, 14, 15, 25, 60, 110]:
        for _ in range(4):
            w = words(rng, n, vocab)
            lines.append(" ".join(w))
            for share in (0.0, 0.1, 0.2, 0.21):
                v = w[:]
                for at in sorted(rng.sample(range(n), max(1, int(n * share))), reverse=True):
                    kind = rng.randrange(3)
                    v[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice(vocab)]
                lines.append(" ".join(v))
    lines += [" ".join(["is", "on"] * k) for k in range(2, 30)]
    docs = documents(lines)
    said = marked(docs)
    expected = similar(lines, [(r["id"], r["doc_id"]) for r in said.dropDuplicates(["id"]).collect()])
    assert {tuple(r) for r in similar_groups(once(*told_apart(said))).collect()} == expected and len(expected) > 100


def test_similar_lines_always_share_a_key(spark):
    rng = random.Random(14)
    long, short = [f"{'w' * rng.randrange(1, 6)}{i}" for i in range(3000)] + ["of", "the", "a", "to"] * 300, [str(i) for i in range(999)]
    nodes = []
    for n in [*range(4, 40), *range(40, 200, 4), 400, 1500]:
        for kind in [*range(6)] * 2:
            vocab = long if len(nodes) % 4 else short
            w = words(rng, n, vocab)
            v = w[:]
            if kind == 0:  # words put in, as many as the longer line allows
                more = next(d for d in range(n, -1, -1) if d <= 0.2 * (n + d) + 1e-9)
                for at in sorted((rng.randrange(n) for _ in range(more)), reverse=True):
                    v.insert(at, rng.choice(vocab))
            else:  # every fifth, or any, changed, taken out, or put elsewhere
                most = int(0.2 * n + 1e-9)
                at = list(range(2, n, 5))[:most] if kind < 3 else sorted(rng.sample(range(n), most))
                for i in reversed(at):
                    v[i : i + 1] = [] if kind == 2 else [rng.choice(vocab)]
                if kind == 5 and most > 1:
                    v = w[:]
                    for _ in range(most // 2):
                        v.insert(rng.randrange(len(v)), v.pop(rng.randrange(len(v))))
            nodes += [(2 * (len(nodes) // 2) + j, len(x), " ".join(x)) for j, x in enumerate((w, v))]
    found = keys(spark.createDataFrame(nodes, "id long, n int, norm string"), 0.8).groupBy(F.expr("id div 2").alias("pair"), "key").agg(F.countDistinct("id").alias("both"))
    met = {r["pair"] for r in found.where("both = 2").select("pair").distinct().collect()}
    assert {a // 2 for (a, _, x), (_, _, y) in zip(nodes[::2], nodes[1::2], strict=True) if x != y} <= met


def test_a_line_has_a_key_once_however_often_it_repeats_a_run(spark):
    rng = random.Random(20)
    vocab = [f"word{i}" for i in range(500)]
    nodes = [" ".join(words(rng, 20, vocab) + times * run + words(rng, 20, vocab)) for times in (2, 9, 100) for run in (["is", "on"], ["on", "is", "the"], ["the"], words(rng, 12, vocab)) for _ in range(4)]
    made = keys(spark.createDataFrame([(i, len(x.split(" ")), x) for i, x in enumerate(nodes)], "id long, n int, norm string"), 0.8)
    times = made.groupBy("key", "id").count().agg(F.max("count"), F.countDistinct("id")).first()
    assert tuple(times) == (1, len(nodes))


def test_line_dedup_recall_over_whole_table(spark):
    """All pairs by edit similarity alone (those of lines that share no two neighbouring words aside) against groups found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    said = marked(docs)
    text = {(r["doc_id"], i): x for r in docs.collect() for i, x in enumerate((r["text"] or "").split("\n"))}
    lines = {r["id"]: re.findall(r"[^\W_]+", text[r["doc_id"], r["pos"]].lower()) for r in said.collect()}
    group = {r["id"]: r["component"] for r in similar_groups(once(*told_apart(said))).collect()}
    having = collections.defaultdict(set)
    for i, w in lines.items():
        for two in zip(w, w[1:]):
            having[two].add(i)
    pairs = {(a, b) for ids in having.values() if len(ids) <= 300 for a in ids for b in ids if a < b and abs(len(lines[a]) - len(lines[b])) <= 0.2 * max(len(lines[a]), len(lines[b]))}
    recall = collections.defaultdict(list)
    for a, b in pairs:
        x, y = lines[a], lines[b]
        most = int(0.2 * max(len(x), len(y)) + 1e-9)
        if sum((collections.Counter(x) & collections.Counter(y)).values()) >= max(len(x), len(y)) - most and edit(x, y) <= most:
            recall[min(60, len(x) // 20 * 20)].append(a in group and group[a] == group.get(b))
    print({n: (sum(v), len(v)) for n, v in sorted(recall.items())})
    every = [x for v in recall.values() for x in v]
    assert len(every) > 300 and sum(every) >= 0.99 * len(every)


def test_crowded_keys_are_compared_in_lots_without_the_nodes_other_keys(spark, monkeypatch):
    rng, tables = random.Random(15), []
    keyed = [(key, i, rng.randrange(400)) for i in range(300) for key in rng.sample(range(4), 2)]
    mark = {i: fp for _, i, fp in keyed}
    keyed = [(key, i, mark[i]) for key, i, _ in keyed]
    having = collections.defaultdict(list)
    for key, i, _ in keyed:
        having[key].append(i)
    links = {(a, b) for ids in having.values() for a in ids for b in ids if a < b and abs(mark[a] - mark[b]) <= 1}
    parent = {i: i for i in mark}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {i for two in links for i in two}

    def settle(df, label="step"):
        tables.append((label, df.columns))
        return settled(df, label)

    settled = common.settle
    monkeypatch.setattr(common, "settle", settle)
    monkeypatch.setattr(common, "LOT_ROWS", 100, raising=False)
    monkeypatch.setattr(common, "CROWD_REACH", 1)  # leaves links to the lots
    out = common.link_groups(spark.createDataFrame(keyed, "key long, id long, fp long"), lambda a, b: F.abs(a - b) <= 1, lambda fp: (F.array(fp), F.array(fp - 1, fp, fp + 1)))
    assert {tuple(r) for r in out.collect()} == {(i, find(i)) for i in linked}
    assert sum(label == "far" for label, _ in tables) > 2 and all("keys" not in names for _, names in tables)


def test_lines_of_one_hash_are_told_apart(spark):
    said = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "id long, check long")
    apart, again = told_apart(said)
    ids = [r["id"] for r in apart.orderBy("check").collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] == 2 and [r["id"] for r in again.collect()] == ids[:1]
    assert told_apart(said.where("check <> 6"))[0].where("id = 1").count() == 2


def test_line_dedup_links_at_the_stated_similarity(spark, documents):
    rng = random.Random(13)
    lines = [" ".join(words(rng, n, [f"word{i}" for i in range(900)])) for n in (10, 30, 100)]
    near = [" ".join(f"other{i}" if i % 5 == 2 else w for i, w in enumerate(line.split())) for line in lines]
    far = [" ".join(f"third{i}" if i % 5 == 2 or i == 0 else w for i, w in enumerate(line.split())) for line in lines]
    out = dedup_lines(documents(lines + near + far)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0] * 3 + [1] * 3 + [0] * 3


def test_line_dedup_ignores_punctuation_and_white_space(spark, documents):
    line = "one, two. three \"four\" five; six"
    docs = [line, "one two\tthree  four five six\r", " One Two (three) four - five six!", "x\ty", "x y\r", "* * * * *", "* * * * * *", "*\t* * * *\r", "\t\r", "\t\r", "kát", "kat"]
    out = dedup_lines(documents(docs)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0]


def test_line_dedup_takes_lines_of_short_words_and_without_spaces(spark, documents):
    docs = ["it is as it was in it", "it is as it was on it", "1 2 3 4 5 6 7 8 9 10", "1 2 3 4 5 6 7 8 9 11", "今天天气很好我们去公园", "今天天气很好我们去学园", "สวัสดีครับทุกคน", "สวัสดีครับทุกค่น", "a b c", "a b d", "a b c d", "a b c d e"]
    out = dedup_lines(documents(docs)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 1]


def test_ordered_crowds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(common, "CROWD_REACH", 2)
    real, mixed = common.settle, []
    monkeypatch.setattr(common, "settle", lambda df, label="step": (out := real(df, label), mixed.append(out.count()) if label == "mixed" else None)[0])
    rng = random.Random(17)
    fps = {i: rng.randrange(10, 400) for i in range(300)}
    keyed = [(key, i, fps[i]) for key in range(40) for i in rng.sample(range(300), rng.randrange(2, 40))]
    alike = lambda a, b: abs(a - b) <= max(a, b) // 50
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = set()
    for a in keyed:
        for b in keyed:
            if a[0] == b[0] and a[1] < b[1] and alike(a[2], b[2]):
                linked |= {a[1], b[1]}
                x, y = sorted((find(a[1]), find(b[1])))
                root[y] = x
    one = lambda fp: (F.array(F.lit(0)), F.array(F.lit(0)))
    near = lambda a, b: F.abs(a - b) <= F.floor(F.greatest(a, b) / 50)
    out = common.link_groups(spark.createDataFrame(keyed, "key long, id long, fp long"), near, one, ordered=True)
    assert {tuple(r) for r in out.collect()} == {(i, find(i)) for i in linked}
    assert len(linked) > 100 and mixed[0] < len(keyed) / 3


def test_line_dedup_keeps_no_scratch_but_its_result(spark, documents):
    from pathlib import Path

    rng = random.Random(18)
    lines = [" ".join(words(rng, 30, [f"word{i}" for i in range(200)])) for _ in range(50)]
    root = Path(common.scratch_root(spark).removeprefix("file:"))
    before = {p.name for p in root.glob("*")}
    out = dedup_lines(documents(lines + [f"{x} end" for x in lines]))
    assert {p.name.split("-")[0] for p in root.glob("*") if p.name not in before} == {"gone"}
    assert out.agg(F.sum("n_removed")).first()[0] == 50


def test_long_lines_share_neighbours_as_far_as_edits_allow(spark, documents):
    rng = random.Random(19)
    vocab = [f"word{i}" for i in range(60)]
    pairs, edits = [], []
    for n in (101, 150, 400):
        line = words(rng, n, vocab)
        for e in (1, n // 10, n // 5 - 1):
            other = list(line)
            for at in sorted(rng.sample(range(n), e), reverse=True):
                kind = rng.randrange(3)
                other[at : at + (kind < 2)] = [] if kind == 0 else [f"new{rng.randrange(5)}"]
            pairs.append((" ".join(line), " ".join(other)))
            edits.append(e)
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", neighbours(F.col("a")).alias("a"), neighbours(F.col("b")).alias("b")).orderBy("i").collect()
    both = [(set(r["a"]), set(r["b"]), e) for r, e in zip(got, edits, strict=True) if r["b"]]  # with 100 words or fewer there are none
    assert len(both) >= 6 and all(len(a) > 50 and len(a - b) <= 2 * e and len(b - a) <= 2 * e for a, b, e in both)
    line = [f"word{i}" for i in range(200)]
    near, far = ([f"other{i}" if i % 5 == 2 or i in also else w for i, w in enumerate(line)] for also in ((), (0,)))
    shuffled = " ".join(sorted(line, key=lambda w: hash((w, 3)) % 97))
    out = dedup_lines(documents([" ".join(line), " ".join(near), shuffled, " ".join(far).replace("other", "third")])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in out] == [0, 1, 0, 0]
