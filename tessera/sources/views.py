"""Market views over the star-schema tables: a daily bar panel, ticks, industries and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a supplier's line items of one ship date. One aggregation, partial before the shuffle."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    by = F.struct(*TIE)
    bars = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("datetime"), F.col("l_suppkey").cast("string").alias("vt_symbol")).agg(
        F.min_by(price, by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, by).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"), F.count("*").cast("double").alias("open_interest"),
    )
    return bars.withColumn("vwap", F.col("turnover") / F.col("volume"))


PANEL_SQL = """
panel AS (
  SELECT l_shipdate AS datetime, CAST(l_suppkey AS VARCHAR) AS vt_symbol,
         arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover, CAST(count(*) AS DOUBLE) AS open_interest,
         sum(l_extendedprice) / sum(l_quantity) AS vwap
  FROM (SELECT *, l_extendedprice / l_quantity AS p,
               row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k FROM lineitem) s
  GROUP BY 1, 2)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: an event is a trade of its type at its value; volume is the running count of the type's events."""
    events = table(spark, sf_dir, "events")
    running = W.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.select(
        F.col("ts").alias("datetime"), F.col("event_type").alias("vt_symbol"), F.col("value").alias("last_price"), "event_id",
        F.count("*").over(running).cast("double").alias("volume"),
    )


TICKS_SQL = """
ticks AS (
  SELECT ts AS datetime, event_type AS vt_symbol, value AS last_price, event_id,
         CAST(count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS volume
  FROM events)"""


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vt_symbol, nation, region)`` of each supplier."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(F.col("s_suppkey").cast("string").alias("vt_symbol"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def monthly_members(bars: DataFrame, k: int) -> DataFrame:
    """``(month, vt_symbol)``: the k symbols of largest turnover in each month, ties to the smaller symbol."""
    by_month = bars.groupBy(F.date_trunc("month", "datetime").alias("month"), "vt_symbol").agg(F.sum("turnover").alias("t"))
    nth = F.row_number().over(W.partitionBy("month").orderBy(F.desc("t"), "vt_symbol"))
    return by_month.withColumn("n", nth).where(F.col("n") <= k).select("month", "vt_symbol")
