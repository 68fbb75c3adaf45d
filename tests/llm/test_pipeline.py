import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.queries import ORACLES, QUERIES


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]


def test_pipeline_catches_what_is_planted(spark, documents, tmp_path):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    body = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(20)) for _ in range(n))
    items = [" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(5)]
    texts, toxic = [], []
    for i in range(300):
        t = body(rng.randrange(2, 6))
        if i % 5 == 0:
            t += " zwurgle xoxqut"
        texts.append(t)
        toxic.append((i, int(i % 5 == 0)))
    texts += [texts[1], body(1) + " " + items[0] + " " + body(1), texts[2] + "\nshared licence line of words that repeats here", texts[3] + "\nshared licence line of words that repeats here"]
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == documents([]).columns
    clean = {i for i in range(300) if i % 5}
    assert not kept["toxicity"].keys() & {i for i in range(0, 300, 5)} and clean <= kept["toxicity"].keys()
    assert kept["line_dedup"].keys() == kept["toxicity"].keys() and kept["line_dedup"][300]["text"] == ""
    lines = [x for r in kept["line_dedup"].values() for x in r["text"].split("\n") if x]
    assert len(lines) == len(set(lines)) and "shared licence line of words that repeats here" in lines
    assert clean <= kept["simhash_near_dedup"].keys() and clean <= kept["decontamination"].keys()
    assert 301 in kept["simhash_near_dedup"] and 301 not in kept["decontamination"]
    assert kept["best_fit_packing"].keys() == kept["decontamination"].keys()
    whole = {r["doc_id"]: r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("length")).collect()}
    assert whole.keys() == kept["best_fit_packing"].keys()


def test_rest_works_without_this_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[2]
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, *a):\n        if n == 'corpus_pipeline' or n.startswith('tessera.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
