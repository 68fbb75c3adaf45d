import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators.resample import bars_from_ticks
from tessera.streaming.bars import cooled, last_bars, minute_bars, traded

TICKS = "datetime timestamp_ntz, vt_symbol string, last_price double, event_id long, volume double"


def ticks(spark, n=300):
    t = dt.datetime(2024, 1, 1, 9)
    rows = [(t + dt.timedelta(seconds=7 * i), "ab"[i % 2], 10.0 + i % 13, i, float(i * 2)) for i in range(n)]
    return spark.createDataFrame(rows, TICKS)


def drain(stream, spark, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streamed_bars_are_the_batch_bars(spark, tmp_path):
    ticks(spark).repartition(1).write.parquet(f"{tmp_path}/ticks")
    source = spark.readStream.schema(TICKS).parquet(f"{tmp_path}/ticks")
    steps = drain(traded(source), spark, tmp_path, "steps")
    steps.write.parquet(f"{tmp_path}/steps")
    streamed = drain(minute_bars(spark.readStream.schema(steps.schema).parquet(f"{tmp_path}/steps")), spark, tmp_path, "bars")
    batch = bars_from_ticks(ticks(spark))
    columns = ["vt_symbol", "datetime", "open", "high", "low", "close", "volume", "n_ticks"]
    got, all_ = ({tuple(r) for r in df.select(*columns).collect()} for df in (streamed, batch))
    assert got <= all_ and len(got) >= len(all_) - 8  # the last minutes are still open


def test_last_bars_and_cooldown(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=i), "a", 1.0, 1.0, 1.0, float(i), 1.0) for i in range(30)]
    spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, open double, high double, low double, close double, volume double").write.parquet(f"{tmp_path}/b")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/b").schema).parquet(f"{tmp_path}/b")
    out = drain(last_bars(source, 25, lambda b: {"mean": b["close"].tail(3).mean()}, "mean double"), spark, tmp_path, "lastn").orderBy("datetime").collect()
    assert len(out) == 10 and out[0]["mean"] == 19 and out[-1]["mean"] == 28
    alerts = spark.createDataFrame([(s, pd.Timestamp(t + dt.timedelta(seconds=x)).to_pydatetime(), "UP") for s, x in (("a", 0), ("a", 30), ("a", 61), ("b", 5))], "vt_symbol string, datetime timestamp_ntz, alert string")
    alerts.write.parquet(f"{tmp_path}/al")
    kept = drain(cooled(spark.readStream.schema(alerts.schema).parquet(f"{tmp_path}/al")), spark, tmp_path, "cool")
    assert {(r["vt_symbol"], r["datetime"].second + 60 * r["datetime"].minute) for r in kept.withColumn("x", F.lit(1)).collect()} == {("a", 0), ("a", 61), ("b", 5)}
