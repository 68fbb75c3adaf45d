import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import alpha101, alpha158
from tessera.plans.formula import FormulaError, evaluate, parse

NAN = float("nan")


def values(spark, xs, formula, ys=None):
    rows = [(f"2024-01-{i + 1:02d}", "a", x, ys[i] if ys else 1.0) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "d string, vt_symbol string, x double, y double").withColumn("datetime", F.col("d").cast("timestamp_ntz"))
    out = evaluate(df, {"v": formula}, keep=("datetime",)).orderBy("datetime").collect()
    return [None if r["v"] is None else round(float(r["v"]), 4) for r in out]


@pytest.mark.parametrize(
    ("formula", "expected"),
    [
        ("ts_sum(x, 3)", [None, None, 6, 7, 9]),
        ("ts_mean(x, 3)", [1, 2, 2, 2.3333, 3]),
        ("ts_std(x, 3)", [0, 1, 0.8165, 0.4714, 1.4142]),
        ("ts_min(x, 3)", [1, 1, 1, 2, 2]),
        ("ts_max(x, 3)", [1, 3, 3, 3, 5]),
        ("ts_argmax(x, 3)", [None, None, 2, 1, 3]),
        ("ts_argmin(x, 3)", [None, None, 1, 2, 1]),
        ("ts_rank(x, 3)", [None, None, 0.6667, 0.5, 1]),
        ("ts_quantile(x, 3, 0.8)", [None, None, 2.6, 2.6, 3.8]),
        ("ts_slope(x, 3)", [None, None, 0.5, -0.5, 1.5]),
        ("ts_rsquare(x, 3)", [None, None, 0.25, 0.75, 0.75]),
        ("ts_resi(x, 3)", [None, None, -0.5, 0.1667, 0.5]),
        ("ts_decay_linear(x, 3)", [None, None, 1.8333, 2.5, 2.5]),
        ("ts_product(x, 3)", [None, None, 6, 12, 20]),
        ("ts_delay(x, 1)", [None, 1, 3, 2, 2]),
        ("ts_delay(x, -1)", [3, 2, 2, 5, None]),
        ("ts_delta(x, 1)", [None, 2, -1, 0, 3]),
    ],
)
def test_rolling_values(spark, formula, expected):
    assert values(spark, [1.0, 3.0, 2.0, 2.0, 5.0], formula) == expected


def test_missing_values_in_windows(spark):
    xs = [1.0, None, NAN, 4.0]
    assert values(spark, xs, "ts_mean(x, 2)")[3] == 4
    assert values(spark, xs, "ts_sum(x, 2)")[1] is None
    assert values(spark, [2.0, 2.0, 2.0], "ts_rsquare(x, 3)") == [None, None, None]
    assert math.isnan(values(spark, [2.0, 2.0, 2.0], "ts_corr(x, y, 3)")[2])


def test_ieee_arithmetic(spark):
    got = values(spark, [1.0, -1.0, 0.0], "x / (y - 1)")
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert values(spark, [0.0], "log(x)")[0] == -math.inf
    assert math.isnan(values(spark, [-1.0], "log(x)")[0])
    assert values(spark, [4.0, -4.0, 0.0, None], "pow1(x, 0.5)") == [2, -2, 0, 0]
    assert values(spark, [2.0, -2.0, -2.0], "pow2(x, y)", [2.0, 3.0, 0.5]) == [4, -8, 0]
    assert values(spark, [1.0, 3.0, None], "quesval(2, x, 10, 20)") == [20, 10, 20]
    assert values(spark, [1.0, 3.0], "quesval2(y, x, 10, 20)", [2.0, 2.0]) == [10, 20]


def test_cross_section(spark):
    rows = [("2024-01-01", s, x) for s, x in zip("abcde", [10.0, 20.0, 20.0, None, -50.0], strict=True)]
    df = spark.createDataFrame(rows, "d string, vt_symbol string, x double").withColumn("datetime", F.col("d").cast("timestamp_ntz"))
    out = evaluate(df, {"r": "cs_rank(x)", "s": "cs_scale(x)", "t": "cs_sum(x)"}, keep=("vt_symbol",)).orderBy("vt_symbol").collect()
    assert [r["r"] for r in out] == [2, 3.5, 3.5, None, 1]
    assert [r["s"] for r in out] == [0.1, 0.2, 0.2, None, -0.5]
    assert {r["t"] for r in out} == {0}


def test_rows_in_any_order_and_short_names(spark):
    import random

    xs = [float(x) for x in (5, 1, 4, 2, 8, 3)]
    rows = [(f"2024-01-{i + 1:02d}", "a", x) for i, x in enumerate(xs)]
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    make = lambda r: spark.createDataFrame(r, "d string, vt_symbol string, close double").withColumn("datetime", F.col("d").cast("timestamp_ntz"))
    a, b = (evaluate(make(r), {"v": "ts_decay_linear(delta(close, 1), 2)"}, keep=("datetime",)).orderBy("datetime").collect() for r in (rows, mixed))
    assert a == b


def test_only_formulas_parse():
    for bad in ("__import__('os')", "x.y", "x[0]", "lambda: 1", "unknown(x, 1)", "ts_mean(x)", "ts_mean(x, y)", "nothing", "x +"):
        with pytest.raises(FormulaError):
            parse(bad, {"x", "y"})


def test_libraries_parse():
    columns = {"open", "high", "low", "close", "volume", "vwap"}
    assert len(alpha158.features()) == 158
    assert len(alpha101.features()) == 82 and len(alpha101.features(True)) == 100
    for text in (*alpha158.features().values(), *alpha101.features(True).values()):
        parse(text, columns)


def test_recursive_functions_do_not_mix_symbols(spark):
    rows = [(f"2024-01-{i + 1:02d}", s, float(10 + i * (1 if s == "a" else -1))) for s in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "d string, vt_symbol string, close double").withColumn("datetime", F.col("d").cast("timestamp_ntz"))
    out = evaluate(df, {"v": "ta_rsi(close, 5)"}, keep=("datetime", "vt_symbol")).orderBy("vt_symbol", "datetime").collect()
    assert out[10]["v"] == 100 and out[30]["v"] == 0 and out[20]["v"] is None


def test_equal_windows_have_equal_values_to_the_last_bit(spark):
    """Ranks of alphas tell values apart that differ in the last bit: rows before a window must not be seen in it."""
    rng = random.Random(21)
    last = [(rng.uniform(900, 2000), rng.uniform(1, 50)) for _ in range(12)]
    rows = [(s, i, *(last[i - s] if i >= s else (rng.random(), rng.random()))) for s in (0, 1, 7, 50, 333) for i in range(s + 12)]
    panel = spark.createDataFrame([(f"s{s}", datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i), a, b) for s, i, a, b in rows], "vt_symbol string, datetime timestamp_ntz, close double, volume double")
    made = evaluate(panel, {"decay": "ts_decay_linear(close, 10)", "corr": "corr(close, close, 9)"}, keep=("datetime", "vt_symbol"))
    ends = {r["vt_symbol"]: (r["decay"], r["corr"]) for r in made.orderBy("datetime").collect()}
    assert len(ends) == 5 and len(set(ends.values())) == 1
    x = [v[0] for v in last]
    assert ends["s0"][0] == sum((k + 1) * v for k, v in enumerate(x[:-11:-1])) / 55
    mean = spread = 0.0
    for n, v in enumerate(x[-9:], 1):  # as DuckDB adds up a variance
        before, mean = mean, mean + (v - mean) / n
        spread += (v - before) * (v - mean)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?::DOUBLE[]) AS x", [x[-9:]])
    assert con.execute("SELECT stddev_pop(x) FROM t").fetchone()[0] == math.sqrt(spread / 9)
    assert ends["s0"][1] == spread / 9 / (math.sqrt(spread / 9) * math.sqrt(spread / 9))
