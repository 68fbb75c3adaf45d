"""Shared plumbing: column picking, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take(df: DataFrame, **wanted: str) -> DataFrame:
    """Exactly the wanted columns, as ``new_name=column``, whatever else ``df`` carries.

    Columns are found by position, an exact spelling first, so extra columns whose names clash with the
    wanted ones (also by case) or with an operator's own output do no harm.
    """
    placed = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return placed.select(*(F.col(f"_in{place(df.columns, old)}").alias(new) for new, old in wanted.items()))


def place(names: list[str], wanted: str) -> int:
    """Position of a column, an exact spelling first, else one that differs by case alone."""
    same = [i for i, n in enumerate(names) if n == wanted] or [i for i, n in enumerate(names) if n.lower() == wanted.lower()]
    if not same:
        raise ValueError(f"no column {wanted!r} among {names}")
    return same[0]


def small(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, or ``weight`` sums to no more; as it is otherwise."""
    size = df.agg(F.sum(weight) if weight is not None else F.count(F.lit(1))).first()[0] or 0
    return F.broadcast(df) if size <= rows else df


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tessera-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends here, lost executors cost nothing.

    The write's shuffle files go when it is done, not when the driver next collects garbage; nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if getattr(_within, "made", None):
        _within.made[-1].append(out)
    return out


#: In ``made`` a list for each ``settle_alone`` that runs in this thread, of what was settled meanwhile.
_within = threading.local()


def settle_alone(make: Callable[[], DataFrame], label: str = "step") -> DataFrame:
    """What ``make`` returns, settled; the tables that were settled meanwhile, which only it needs, are deleted."""
    _within.made = [*getattr(_within, "made", []), []]
    try:
        out = settle(make(), label)
    finally:
        *_within.made, inner = _within.made
    for made in inner:
        if made is not out:
            discard(made)
    if _within.made:
        _within.made[-1].append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what ``settle`` wrote for ``df``; call it only when nothing will read it again."""
    path = getattr(df, "settled_at", None)
    if path:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this application. Results that were not written yet become unreadable."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: a row ``(id, component)`` for each node, component being its smallest id.

    Rounds of contraction: each node joins the least of itself and its neighbours in a random order (hashes of the ids,
    different ones for different ids), and edges between what they joined go to the next round, of which there are about
    as many as digits in the number of nodes. Each round is one aggregation and two equi-joins of what is left, so a hub's
    neighbours never meet in one group. Self-loops and repeated edges are ignored; no edges give no rows.
    """
    state = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    order, joined = F.xxhash64, []
    for _ in range(limit):
        both = state.select("a", order("b").alias("m")).unionAll(state.select(F.col("b").alias("a"), order("a").alias("m")))
        joined.append(settle(both.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("id"), F.least(order("a"), "m").alias("m")), "joined"))
        here = joined[-1]
        moved = state.join(here.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(here.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
        after = settle(moved.where("ma <> mb").select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b")).distinct(), "edges")
        discard(state)
        state, order = after, F.xxhash64
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {limit} rounds")
    label = joined[-1]
    for here in reversed(joined[:-1]):
        up = label.select(F.col("id").alias("m"), F.col("m").alias("top"))
        label = here.join(up, "m", "left").select("id", F.coalesce("top", "m").alias("m"))
    label = settle(label, "labels")
    least = label.groupBy("m").agg(F.min("id").alias("component"))
    return label.join(least, "m").select("id", "component")


#: Neighbours in a crowded key that a node is compared with before all nodes of other components are.
CROWD_REACH = 15
#: Rows of crowded keys for each of the lots in which their nodes are compared with other components, and lots at most.
LOT_ROWS = 1_500_000
LOTS = 8


def link_groups(keyed: DataFrame, alike, split, judge=None, reach: int = 1, alone: bool = False, ordered: bool = False) -> DataFrame:
    """Components ``(id, component)`` of nodes that share a key and are ``alike``, a function of two fingerprint columns.

    ``keyed(key long, id long, fp long)`` has one row for each node and key; ``fp`` depends on ``id`` alone.
    ``split`` is a function of a fingerprint column that divides crowded keys: an array of numbers under which a node is
    found, and one of those under which those like it are looked for. Of nodes that are alike, at least one number of the
    one's second array is in the other's first. With ``alone`` these numbers are apart enough without the keys, and a node is
    divided once, not once in each of its crowded keys. With ``ordered`` a fingerprint between two that are alike is like
    both. ``judge``, if given, returns three things: ``(id, sign)`` of each node, a
    function of two signs that says which pairs are worth a look, and a function that takes candidate pairs ``(a, b)``, and
    whether they have been looked at in this way, and returns those that hold.

    All links count, yet a group of g nodes never yields g*g pairs. First each node is tried against its group's leader
    and, in a group of up to three, or ``reach + 1``, the ``reach`` nodes before it, which covers all pairs of such a group
    and joins most of a larger one. Larger groups get a second linear pass with the nodes before in fingerprint order.
    That is all pairs of a group of up to ``CROWD_REACH + 1``, and with ``ordered`` all those of a node that is not like the
    ones just out of that reach; one that is not like those next to it has no pair at all. Of the rest, only nodes outside the group's largest component so far are then compared with
    the nodes of other components, under the same number of ``split``; pairs inside one component cannot change the result.
    Nodes without a link are absent from the result. Scratch tables are deleted as soon as nothing reads them again.
    """
    in_key = W.partitionBy("key").orderBy("fp", "id")
    node = F.struct("id", "fp")
    others = {"lead": F.first(node).over(in_key.rowsBetween(W.unboundedPreceding, W.currentRow))}
    others |= {f"prev{i}": F.lag(node, i).over(in_key) for i in range(1, reach + 1)}
    in_all = F.count(F.lit(1)).over(in_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    like = lambda far: F.coalesce(alike(F.lag("fp", far).over(in_key), F.col("fp")), F.lit(False)) | F.coalesce(alike(F.lead("fp", far).over(in_key), F.col("fp")), F.lit(False))
    rest = like(CROWD_REACH + 1) if ordered else in_all > CROWD_REACH + 1
    met_here = like(1) if ordered else F.lit(True)
    tried = keyed.select("key", "id", "fp", (in_all > max(3, reach + 1)).alias("many"), rest.alias("rest"), met_here.alias("some"), *(c.alias(n) for n, c in others.items()))
    near = lambda c: F.when((F.col(f"{c}.id") != F.col("id")) & alike(F.col(f"{c}.fp"), F.col("fp")), F.col(f"{c}.id"))
    tried = tried.select("key", "id", "fp", (F.col("many") & F.col("some")).alias("many"), "rest", F.array_compact(F.when(F.col("many"), F.array(near("lead"))).otherwise(F.array(*map(near, others)))).alias("to"))
    tried = settle(tried.where("many or size(to) > 0"), "tried")
    crowd = tried.where("many").select("key", "id", "fp", "rest")
    verify, worth = (lambda pairs, sifted: pairs), (lambda a, b: F.lit(True))
    if judge:
        signs, worth, verify = judge()
        crowd = crowd.join(signs, "id")
    else:
        crowd = crowd.withColumn("sign", F.lit(None).cast("int"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    to = tried.select("id", F.explode("to").alias("other")).select(*pair(F.col("id"), F.col("other")))
    first = settle_alone(lambda: verify(to.distinct(), False), "links")
    found = settle_alone(lambda: components(first), "parts")
    discard(first)

    # Crowded keys once more, against more neighbours of other components: most of what the cross phase would find pair by pair.
    parted = lambda rows: rows.join(found, "id", "left").select("key", "id", "fp", "sign", F.coalesce("component", "id").alias("part"))
    placed = parted(crowd)
    beside = placed.select("id", "fp", "sign", "part", *(F.lag(F.struct("id", "fp", "sign", "part"), i).over(in_key).alias(f"prev{i}") for i in range(1, CROWD_REACH + 1)))
    close = lambda c: F.when((F.col(f"{c}.part") != F.col("part")) & alike(F.col(f"{c}.fp"), F.col("fp")) & worth(F.col(f"{c}.sign"), F.col("sign")), F.col(f"{c}.id"))
    beside = beside.select("id", F.explode(F.array_compact(F.array(*(close(f"prev{i}") for i in range(1, CROWD_REACH + 1))))).alias("other"))
    again = settle_alone(lambda: verify(beside.select(*pair(F.col("id"), F.col("other"))).distinct(), True), "links")
    if not again.isEmpty():
        before, found = found, settle_alone(lambda: merge(found, again), "parts")
        discard(before)
    discard(again)
    placed = parted(crowd.where("rest"))
    counted = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    placed = placed.join(mixed, "key")
    under, look = split(F.col("fp"))
    if alone:
        placed = settle(placed.groupBy("id", "fp", "sign", "part").agg(F.max(F.col("part") != F.col("main")).alias("odd")), "mixed")
        by, lots = ["sub"], 1
    else:
        placed = settle(placed.select("key", "id", "fp", "sign", "part", (F.col("part") != F.col("main")).alias("odd")), "mixed")
        by, lots = ["key", "sub"], min(LOTS, 1 + placed.count() // LOT_ROWS)
    discard(tried)
    first_met = ~F.col("odd") | (F.col("id") < F.col("id2"))  # of two odd nodes each looks for the other
    met = []
    for lot in range(lots):  # a lot of whole keys after another: the shuffle's files are never those of all
        here = placed.where(F.pmod(F.xxhash64("key"), F.lit(lots)) == lot) if lots > 1 else placed
        odd = here.where("odd").select(*by[:-1], F.explode(look).alias("sub"), *(F.col(c).alias(f"{c}2") for c in ("id", "fp", "sign", "part")))
        far = odd.join(here.select(*by[:-1], F.explode(under).alias("sub"), "id", "fp", "sign", "part", "odd"), by)
        far = far.where((F.col("part") != F.col("part2")) & alike(F.col("fp"), F.col("fp2")) & worth(F.col("sign"), F.col("sign2")) & first_met)
        far = far.select(*pair(F.col("id"), F.col("id2"))).distinct()
        met.append(settle(far, "far") if lots > 1 else far)
    more = settle_alone(lambda: verify(reduce(DataFrame.unionAll, met).distinct() if lots > 1 else met[0], True), "links")
    for made in (placed, *met):
        discard(made)
    if more.isEmpty():
        return found
    return merge(found, more)


def merge(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``found(id, component)`` joined by further ``links(a, b)``: only the components that links touch are gone through again."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    ends = settle(ends, "ends")
    of = lambda side: ends.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    across = settle(components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "across")
    up = across.select(F.col("id").alias("component"), F.col("component").alias("top"))
    nodes = found.unionByName(ends.where("id = component").join(found, "id", "left_anti"))
    return nodes.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
