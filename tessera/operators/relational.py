"""Membership, upserts, selection, returns by quantile: the relational side of factor research."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import cross


def in_range(df: DataFrame, start=None, end=None, column: str = "datetime") -> DataFrame:
    """Rows dated start..end, both included; an empty bound is open."""
    if start not in (None, ""):
        df = df.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end not in (None, ""):
        df = df.where(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return df


def padded_range(df: DataFrame, start, end, extended_days: int, column: str = "datetime") -> DataFrame:
    """``in_range`` with ``extended_days`` before the start and a tenth of that after the end."""
    first = F.lit(start).cast("timestamp_ntz") - F.make_dt_interval(F.lit(int(extended_days)))
    last = F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(F.lit(int(extended_days) // 10))
    return df.where(F.col(column).between(first, last))


def member_filter(panel: DataFrame, intervals: DataFrame, symbol: str = "vt_symbol", time: str = "datetime") -> DataFrame:
    """Rows of ``panel`` that lie in any of their symbol's ``intervals(vt_symbol, start, end)``; overlaps repeat no row."""
    spans = intervals.select(F.col("vt_symbol").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    return panel.join(spans, (F.col(symbol) == F.col("_s")) & F.col(time).between(F.col("_a"), F.col("_b")), "left_semi")


def islands(members: DataFrame, days: DataFrame | None = None, symbol: str = "vt_symbol", day: str = "date") -> DataFrame:
    """``(vt_symbol, start, end, n_days)``: stretches of consecutive trading days in a membership table.

    Trading days are numbered over ``days`` (the distinct days of ``members`` if not given): one row a day, not a row a member.
    """
    calendar = (days if days is not None else members).select(day).distinct()
    numbered = calendar.withColumn("_n", F.row_number().over(W.orderBy(day)))  # as many rows as there are days
    placed = members.select(symbol, day).distinct().join(numbered, day)
    run = F.col("_n") - F.row_number().over(W.partitionBy(symbol).orderBy(day))
    out = placed.withColumn("_run", run).groupBy(symbol, "_run").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("n_days"))
    return out.drop("_run")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of both by key, the row of ``new`` where both have one; of repeated keys within one, the largest row."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    ordered = F.struct("_v", *(c for c in rest if c != "_v"))
    return both.groupBy(*keys).agg(F.max(ordered).alias("_r")).select(*keys, *(f"_r.{c}" for c in rest if c != "_v"))


def last_n(df: DataFrame, n: int, by: str = "vt_symbol", order: str = "datetime", whole: bool = True) -> DataFrame:
    """The last n rows of each group; with ``whole``, of groups that have as many."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    out = df.withColumn("_nth", nth).where(F.col("_nth") <= n)
    if whole:
        out = out.withColumn("_all", F.count("*").over(W.partitionBy(by))).where(F.col("_all") == n).drop("_all")
    return out.drop("_nth")


def top_k(df: DataFrame, k: int, score: str, by: str = "datetime", tie: str = "vt_symbol", largest: bool = True) -> DataFrame:
    """The k rows of the best score on each date, with their ``rank``."""
    order = F.desc_nulls_last(score) if largest else F.asc_nulls_last(score)
    return df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order, tie))).where(F.col("rank") <= k)


def overview(bars: DataFrame, by: Sequence[str] = ("vt_symbol",), time: str = "datetime") -> DataFrame:
    """``(…, count, start, end)`` of what is stored."""
    return bars.groupBy(*by).agg(F.count("*").alias("count"), F.min(time).alias("start"), F.max(time).alias("end"))


def close_matrix(panel: DataFrame, symbols: Sequence[str], value: str = "close") -> DataFrame:
    """A row for each date, a column for each of the listed symbols."""
    return panel.groupBy("datetime").pivot("vt_symbol", list(symbols)).agg(F.first(value))


def close_maps(panel: DataFrame, value: str = "close") -> DataFrame:
    """``(datetime, symbols, values)``: a row for each date, all symbols that it has, in order, and their values."""
    rows = panel.groupBy("datetime").agg(F.array_sort(F.collect_list(F.struct("vt_symbol", F.col(value).alias("value")))).alias("rows"))
    return rows.select("datetime", F.col("rows.vt_symbol").alias("symbols"), F.col("rows.value").alias("values"))


def forward_return(periods: int, price: str = "close") -> Column:
    """The return from a row to ``periods`` rows later in its symbol."""
    later = F.lead(price, periods).over(W.partitionBy("vt_symbol").orderBy("datetime"))
    return F.when(F.col(price) != 0, later / F.col(price) - 1)


def quantile_returns(signals: DataFrame, buckets: int = 10, signal: str = "signal", ret: str = "ret", date: str = "datetime") -> DataFrame:
    """``(bucket, n, mean_ret)``: mean forward return by the signal's quantile on its date, ties to the smaller symbol."""
    fine = signals.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    bucket = F.ntile(buckets).over(W.partitionBy(date).orderBy(signal, "vt_symbol"))
    return fine.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(ret).alias("mean_ret"))


def rank_ic(signals: DataFrame, signal: str = "signal", ret: str = "ret", date: str = "datetime") -> DataFrame:
    """``(datetime, n, ic)``: rank correlation of signal and forward return on each date; null where a side is constant."""
    fine = signals.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    ranked = fine.select(date, cross.rank(date, F.col(signal)).alias("a"), cross.rank(date, F.col(ret)).alias("b"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return ranked.groupBy(date).agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop("a", "b") / spread).alias("ic"))


def parameter_grid(spark: SparkSession, axes: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """Every combination of the axes' values ``start, start + step, … <= end``, with an id."""
    out = None
    for name, (start, end, step) in axes.items():
        n = int((end - start) / step + 1e-9) + 1
        axis = spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(name))
        out = axis if out is None else out.crossJoin(axis)
    return out.withColumn("param_id", F.row_number().over(W.orderBy(*axes)))


def pct_change(x: str, by: str = "vt_symbol", order: str = "datetime") -> Column:
    before = F.lag(x).over(W.partitionBy(by).orderBy(order))
    return F.when(before != 0, F.col(x) / before - 1)


def a_share(code: Column) -> Column:
    """Whether a code is an A-share of one of the boards."""
    return code.rlike(r"^(?:sh\.(?:600|601|603|605|688)|sz\.(?:000|001|002|003|300|301))\d{3}$")
