"""Times the headline queries and prints one JSON line. Each query runs once to warm up at sf0.001, then once, written to no sink."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "ts_mean", "ts_rank", "ts_corr", "ts_quantile", "cs_rank", "alpha158_candles", "alpha158_roc_ma_std", "alpha158_sum", "alpha101_3", "alpha101_44",
    "proc_cs_norm_robust", "decile_returns", "rank_ic", "membership_range_join", "bars_minute", "bars_day", "ind_sma", "ind_macd", "factor_signal", "pnl_daily", "bt_statistics",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.queries import QUERIES

    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
