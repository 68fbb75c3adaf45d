import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import smoothing as S
from tessera.operators import accounts, backtest, dataset, factors, indicators, models, processors, relational, resample
from tessera.sources.store import BarStore, FactorStore, read_bar_csv


def bars(spark, n=40, symbols="ab"):
    rng = np.random.default_rng(1)
    rows = []
    for s in symbols:
        price = 100 + rng.normal(0, 1, n).cumsum()
        for i, p in enumerate(price):
            p = float(p)
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=i), s, p - 0.2, p + 1.0, p - 1.0, p, float(1000 + 10 * i)))
    return spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, open double, high double, low double, close double, volume double")


def test_tick_rounding(spark):
    row = spark.range(1).select(N.round_to(F.lit(2.5), 1.0).alias("a"), N.round_to(F.lit(10.237), 0.01).alias("b"), N.floor_to(F.lit(10.237), 0.05).alias("c"), N.ceil_to(F.lit(10.237), 0.05).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (2.0, 10.24, 10.2, 10.25)
    assert backtest.to_tick(2.5, 1) == 2


def test_windowed_and_recursive_indicators_agree_on_a_ring(spark):
    data = bars(spark, symbols="a")
    full = indicators.add(data, {"v": ("sma", 5), "r": ("rsi", 5), "m": ("macd", 3, 6, 3)}).orderBy("datetime").toPandas()
    close = full["close"].to_numpy()
    assert np.allclose(full["v"][4:], pd.Series(close).rolling(5).mean()[4:])
    assert np.allclose(full["r"][5:].astype(float), S.rsi(close, 5)[5:])
    ring = indicators.add(data, {"v": ("sma", 5), "r": ("rsi", 5)}, size=10).orderBy("datetime").toPandas()
    assert ring["v"][:9].isna().all() and np.allclose(ring["v"][9:], full["v"][9:])
    assert np.isclose(ring["r"].iloc[-1], S.rsi(close[-10:], 5)[-1])


def test_processors(spark):
    rows = [("2024-01-01", s, x, 1.0) for s, x in zip("abcd", [1.0, 2.0, 3.0, float("nan")], strict=True)]
    df = spark.createDataFrame(rows, "d string, vt_symbol string, x double, label double").withColumn("datetime", F.col("d").cast("timestamp_ntz"))
    assert processors.drop_na(df, ["x"]).count() == 3
    assert processors.fill_na(df, 0, ["x"]).where("x = 0").count() == 1
    z = [r["x"] for r in processors.cs_norm(df, ["x"], "zscore").orderBy("vt_symbol").collect()]
    assert z == [-1, 0, 1, None]
    robust = [r["x"] for r in processors.cs_norm(df, ["x"]).orderBy("vt_symbol").collect()]
    assert np.isclose(robust[2], 1 / 1.4826) and robust[3] is None
    assert processors.cs_norm(df, ["label"]).where("label is not null").count() == 0
    ranked = [r["x"] for r in processors.cs_rank_norm(df, ["x"]).orderBy("vt_symbol").collect()]
    assert np.allclose(ranked[:3], [(r / 4 - 0.5) * 3.46 for r in (1, 2, 3)])


def test_membership(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5)]
    rows = [(d, "a") for d in days[:2] + days[3:]] + [(d, "b") for d in days]
    out = relational.islands(spark.createDataFrame(rows, "date date, vt_symbol string")).orderBy("vt_symbol", "start").collect()
    assert [(r["vt_symbol"], r["start"].day, r["end"].day, r["n_days"]) for r in out] == [("a", 1, 2, 2), ("a", 4, 5, 2), ("b", 1, 5, 5)]
    twice = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)), ("a", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))], "vt_symbol string, start timestamp_ntz, end timestamp_ntz")
    assert relational.member_filter(bars(spark), twice).count() == 12


def test_upsert_and_selection(spark):
    old = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "y", 5.0), (3, "z", 3.0)], "k int, s string, v double")
    assert {(r["k"], r["v"]) for r in relational.upsert(old, new, ["k", "s"]).collect()} == {(1, 1.0), (2, 5.0), (3, 3.0)}
    assert relational.last_n(bars(spark), 50).count() == 0 and relational.last_n(bars(spark), 5).count() == 10


def test_resampling(spark):
    t = dt.datetime(2024, 1, 1, 9, 0)
    rows = [(t + dt.timedelta(seconds=s), "a", p, i, v) for i, (s, p, v) in enumerate([(0, 10.0, 5.0), (20, 12.0, 8.0), (40, 0.0, 9.0), (59, 11.0, 9.0), (61, 13.0, 4.0), (130, 9.0, 6.0)])]
    ticks = spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, last_price double, event_id long, volume double")
    out = resample.bars_from_ticks(ticks).orderBy("datetime").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"], r["n_ticks"]) for r in out] == [(10, 12, 10, 11, 4, 3), (13, 13, 13, 13, 0, 1), (9, 9, 9, 9, 2, 1)]
    longer = resample.longer_bars(resample.bars_from_ticks(ticks), "minute", 5).first()
    assert (longer["open"], longer["high"], longer["low"], longer["close"], longer["volume"]) == (10, 13, 9, 9, 6)
    filled = resample.fill_bars(bars(spark, 5, "a").where("datetime <> timestamp_ntz '2024-01-03'").unionByName(bars(spark, 5, "b").withColumn("vt_symbol", F.lit("b"))))
    assert filled.where("filled").count() == 1 and filled.where("filled and volume = 0 and open = close").count() == 1


def test_volume_of_ticks_without_a_price(spark, tmp_path):
    import duckdb

    from tessera.queries import ORACLES, QUERIES

    t = dt.datetime(2024, 1, 1, 9, 0)
    rows = [(i, t + dt.timedelta(seconds=s), "a", v) for i, (s, v) in enumerate([(0, 3.0), (20, 0.0), (40, 5.0), (70, 0.0), (130, 4.0), (4000, 0.0), (90000, 2.0)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        for name in ("bars_minute", "bars_15_minutes", "bars_hour", "bars_day"):
            want = sql.execute(f"SELECT datetime, volume, n_ticks FROM ({ORACLES[name]}) ORDER BY datetime").fetchall()
            assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("datetime", "volume", "n_ticks").orderBy("datetime").collect()] == want, name
    ticks = spark.createDataFrame([(r[1], "a", r[3], r[0], float(r[0] + 1)) for r in rows], "datetime timestamp_ntz, vt_symbol string, last_price double, event_id long, volume double")
    assert [r["volume"] for r in resample.bars_from_ticks(ticks).orderBy("datetime").collect()] == [2.0, 2.0, 2.0]  # by itself the operator adds them to the next tick's


def test_factor_signals(spark):
    sample = spark.createDataFrame([("UP", 0.01, 2.0, "NORMAL_VOLUME", 0.01, "NEUTRAL")], "momentum_trend string, momentum double, volume_ratio double, volume_level string, volatility double, price_volume_signal string")
    assert [r["target"] for r in factors.position_signal(factors.ml_signal(sample)).collect()] == ["LONG"]
    scored = factors.score(spark.createDataFrame([(2.0, -1.0), (0.1, 0.0)], "a double, b double"), {"a": 3, "b": 1}, 10)
    assert [r["total_score"] for r in scored.collect()] == [75]
    with pytest.raises(ValueError):
        factors.score(sample, {"nothing": 1})
    out = factors.momentum(bars(spark)).orderBy("vt_symbol", "datetime").collect()
    assert [r["momentum_trend"] for r in out[:5]] == ["UNKNOWN"] * 5 and out[5]["momentum_trend"] != "UNKNOWN"


def test_inflection_positions(spark):
    days = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    closes, entries = [10.0, 10.0, 9.8, 9.7, None, 10.0, 10.6], [False, True, True, True, False, True, True]
    df = spark.createDataFrame([(d, "a", c, e) for d, c, e in zip(days, closes, entries, strict=True)], "datetime timestamp_ntz, vt_symbol string, close double, entry boolean")
    out = factors.inflection_signals(df).orderBy("datetime").collect()  # in at 10, held at 9.8, out at the stop, in again, out at the profit
    assert [(r["datetime"].day, r["direction"]) for r in out] == [(2, "LONG"), (4, "FLAT"), (6, "LONG"), (7, "FLAT")]
    assert factors.inflection_signals(df.where("false")).count() == 0


def test_daily_selection(spark):
    days = pd.bdate_range("2026-01-01", periods=100)
    growth = {"c1": 1.002, "c2": 1.001, "c3": 1.003}
    rows = [(d.date(), c, 10 * g**i, 1e6, "1", "1" if c == "c3" and i == 99 else "0") for c, g in growth.items() for i, d in enumerate(days)]
    data = spark.createDataFrame(rows, "date date, code string, close double, amount double, tradestatus string, isST string")
    universe = spark.createDataFrame([(c, c.upper(), "x") for c in growth], "code string, code_name string, industry string")
    out = factors.daily_selection(data, universe, 2).orderBy("rank").collect()
    assert [r["code"] for r in out] == ["c1", "c2"] and out[0]["trade_date"] == dt.date(2026, 5, 20)
    assert out[0]["momentum_60"] > out[0]["momentum_20"] > 0 and out[0]["average_amount_20"] == 1e6
    assert factors.daily_selection(data, universe, 2, min_amount=2e6).count() == 0


def test_profit_and_loss(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    marks = spark.createDataFrame([(d, "a", c) for d, c in zip(days, [10.0, 12.0, 11.0], strict=True)], "datetime timestamp_ntz, vt_symbol string, close double")
    trades = spark.createDataFrame([(days[0], "a", "LONG", 9.0, 10.0), (days[2], "a", "SHORT", 11.5, 10.0)], "datetime timestamp_ntz, vt_symbol string, direction string, price double, volume double")
    contracts = spark.createDataFrame([("a", 0.001, 0.002, 1.0)], "vt_symbol string, long_rate double, short_rate double, size double")
    daily = backtest.daily_result(marks, trades, contracts)
    out = daily.orderBy("date").collect()
    assert [round(r["net_pnl"], 4) for r in out] == [9.91, 20.0, round(-10 + 5 - 0.23, 4)]
    one = backtest.statistics(daily, capital=1000).first()
    assert one["total_days"] == 3 and one["profit_days"] == 2 and round(one["end_balance"], 2) == 1024.68 and one["max_drawdown_duration"] == 1
    assert backtest.statistics(daily, capital=-50).first()["sharpe_ratio"] == 0


def test_matching():
    days = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"])
    rows = [(d, s, p, p * 1.01, p * 0.99, p, sig) for i, d in enumerate(days) for s, p, sig in (("a", 10.0, 5.0 - i), ("b", 20.0, float(i)))]
    frame = pd.DataFrame(rows, columns=["datetime", "vt_symbol", "open", "high", "low", "close", "signal"])
    trades = backtest.simulate(frame, backtest.Rotation(top=1, drop=1, min_days=2, capital=10_000))
    assert trades[0][:3] == (days[1], "a", "LONG") and trades[0][4] % 100 == 0 and trades[0][3] == 10
    assert any(t[1] == "b" and t[2] == "LONG" for t in trades) and any(t[1] == "a" and t[2] == "SHORT" for t in trades)


def test_rotation_takes_bars_one_time_after_another(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(p, dt.datetime(2024, 1, d), str(s), 10.0 + s, 11.0 + s, 9.0 + s, 10.0 + s, rng.choice([None, rng.random()])) for p in ("a", "b", None) for d in range(1, 20) for s in range(12) if rng.random() < 0.9]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "p string, datetime timestamp_ntz, vt_symbol string, open double, high double, low double, close double, signal double")
    rule = backtest.Rotation(top=3, drop=1, capital=100_000, min_volume=1.0)
    want = {(p, *t) for p in ("a", "b", None) for t in backtest.simulate(df.where(F.col("p").eqNullSafe(p)).toPandas(), rule)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = backtest.run(df, rule, "p")
        assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # a group of that kind is in memory as a whole
        assert {tuple(r) for r in out.collect()} == want and len(want) > 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rotation_buys_for_all_that_are_to_go():
    days = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"])
    signals = {"a": (3.0, 0.0, 0.0), "b": (2.0, 1.0, 1.0), "c": (1.0, 2.0, 2.0)}
    rows = [(d, s, 10.0, 10.2, 9.8, 10.0, x[i]) for i, d in enumerate(days) for s, x in signals.items()]
    frame = pd.DataFrame(rows, columns=["datetime", "vt_symbol", "open", "high", "low", "close", "signal"])
    trades = backtest.simulate(frame, backtest.Rotation(top=1, drop=1, min_days=3, capital=10_000))
    # "a" is too young to go on the second day, yet "c" is bought in its place, from what cash is left.
    assert [(t[0], t[1], t[2], t[4]) for t in trades] == [(days[1], "a", "LONG", 1000.0)]
    more = backtest.simulate(frame, backtest.Rotation(top=1, drop=1, min_days=1, capital=10_000))
    # 950 units round to 1000, which with the commission leave -5 in cash; 10,000 less 15 come in: 9980 * 0.95 / 10 is 948.1, the nearest hundred 900.
    assert [(t[0], t[1], t[2], t[4]) for t in more] == [(days[1], "a", "LONG", 1000.0), (days[2], "a", "SHORT", 1000.0), (days[2], "c", "LONG", 900.0)]


def test_search(spark):
    axes = {"x": (0, 4, 1), "y": (0, 2, 1)}
    assert len(backtest.grid(axes)) == 15
    best = backtest.search(spark, spark.range(3), backtest.grid(axes), lambda rows, s: len(rows) - (s["x"] - 3) ** 2 - s["y"]).first()
    assert best["setting"] == {"x": 3.0, "y": 0.0} and best["value"] == 3
    found = backtest.evolve(lambda many: [-((s["x"] - 3) ** 2) - s["y"] for s in many], axes, 10, 8)
    assert found[0][0] == {"x": 3, "y": 0}


def test_dataset_and_models(spark):
    data = dataset.Dataset(bars(spark, 60, "abc"), {dataset.Segment.TRAIN: ("2024-01-01", "2024-02-10"), dataset.Segment.TEST: ("2024-02-11", "2024-02-29")})
    data.add_feature("f", "ts_mean(close, 3) / close").add_feature("g", "volume").set_label("ts_delay(close, -1) / close - 1")
    data.add_processor("infer", lambda df: processors.cs_norm(df, ["f"], "zscore")).add_processor("learn", lambda df: processors.drop_na(df, ["label"]))
    with pytest.raises(ValueError):
        data.add_feature("h")
    learn = data.fetch_learn(dataset.Segment.TRAIN)
    assert learn.columns == ["datetime", "vt_symbol", "f", "g", "label"] and learn.where("isnan(label)").count() == 0
    for model in (models.Lasso(), models.LeastSquares(), models.Network(hidden=(4,), steps=40)):
        signals = model.fit(learn, ["f", "g"]).predict(data.fetch_infer(dataset.Segment.TEST))
        assert signals.columns == ["datetime", "vt_symbol", "signal"] and signals.count() == 19 * 3


def test_positions_and_risk(spark):
    trades = spark.createDataFrame([(1, "a.SHFE", "LONG", "OPEN", 5.0), (2, "a.SHFE", "SHORT", "CLOSETODAY", 2.0), (3, "b.X", "SHORT", "OPEN", 4.0), (4, "b.X", "LONG", "CLOSE", 1.0)], "seq int, vt_symbol string, direction string, offset string, volume double")
    held = {r["vt_symbol"]: r for r in accounts.holdings(trades).collect()}
    assert held["a.SHFE"]["long_td"] == 3 and held["b.X"]["short_pos"] == 3
    requests = spark.createDataFrame([(1, "b.X", "LONG", 2.0), (2, "b.X", "LONG", 9.0)], "id int, vt_symbol string, direction string, volume double")
    assert [(r["id"], r["offset"], r["volume"]) for r in accounts.split_close(requests, accounts.holdings(trades)).collect()] == [(1, "CLOSETODAY", 2)]
    checked = accounts.risk_check(requests, [(2, "big", "REJECT", F.col("volume") > 5), (1, "any", "WARNING", F.lit(True))]).orderBy("id").collect()
    assert [(r["passed"], r["rule"], r["warnings"]) for r in checked] == [(True, None, ["any"]), (False, "big", ["any"])]
    changes = spark.createDataFrame([("o1", 1, "NOTTRADED"), ("o1", 2, "ALLTRADED"), ("o2", 1, "PARTTRADED")], "vt_orderid string, seq int, status string").withColumn("datetime", F.lit("2024-01-01"))
    assert [r["vt_orderid"] for r in accounts.active_orders(changes).collect()] == ["o2"]


def test_dispatch(spark):
    strategies = spark.createDataFrame([("m", ["*"], ["momentum_20"], True), ("v", ["*"], ["volume_20"], True), ("both", ["a"], ["momentum_20", "volume_20"], True)], "strategy string, symbols array<string>, required array<string>, active boolean")
    events = spark.createDataFrame([(1, "a", ["momentum_20"]), (2, "a", ["momentum_20", "volume_20"])], "event_id int, symbol string, factors array<string>")
    counts = {r["strategy"]: r["count"] for r in accounts.dispatch(strategies, events).groupBy("strategy").count().collect()}
    assert counts == {"m": 2, "v": 1, "both": 1}


def test_store(spark, tmp_path):
    store = BarStore(spark, f"file://{tmp_path}/lab")
    first = bars(spark, 5, "a").withColumns({"turnover": F.col("close") * F.col("volume"), "open_interest": F.lit(0.0)})
    store.save_bars(first)
    store.save_bars(first.where("datetime = timestamp_ntz '2024-01-05'").withColumn("close", F.lit(1.0)))
    assert store.load_bars().count() == 5 and store.load_bars(start="2024-01-05").first()["close"] == 1.0
    assert store.overview().first()["count"] == 5 and store.load_bars("1m").count() == 0
    panel = store.research_panel("d", "2024-01-01", "2024-01-05").orderBy("datetime").collect()
    assert panel[0]["close"] == 1.0
    with pytest.raises(ValueError):
        store.save_bars(first, "3d")
    store.save_contracts({"a": (1, 2, 3, 4)})
    store.save_contracts({"a": (5, 2, 3, 4), "b": (1, 1, 1, 1)})
    assert {r["vt_symbol"]: r["long_rate"] for r in store.load_contracts().collect()} == {"a": 5, "b": 1}
    fs = FactorStore(store)
    fs.save("f", spark.createDataFrame([("2024-01-01", "a", 1.0)], "trade_date string, symbol string, f double"))
    fs.append("f", spark.createDataFrame([("2024-01-01", "a", 2.0), ("2024-01-02", "a", 3.0)], "trade_date string, symbol string, f double"))
    fs.save("g", spark.createDataFrame([("2024-01-01", "a", 9.0)], "trade_date string, symbol string, g double"))
    assert fs.names() == ["f", "g"] and fs.load("f").count() == 2 and fs.merge(["f", "g"]).first()["f"] == 2
    with pytest.raises(ValueError):
        fs.save("h", spark.createDataFrame([], "trade_date string, symbol string, h double"))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,date,open_price,high,low,close,vol\nx,20240102,1,2,0.5,1.5,\ny,2024-01-03,1,2,z,1.5,7\n")
    out = read_bar_csv(spark, str(tmp_path / "a.csv")).orderBy("vt_symbol").collect()
    assert [(r["vt_symbol"], r["datetime"].day, r["open"], r["low"], r["volume"], r["turnover"]) for r in out] == [("x", 2, 1, 0.5, 0, 0), ("y", 3, 1, None, 7, 0)]
    (tmp_path / "b.csv").write_text("date,close\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="vt_symbol"):
        read_bar_csv(spark, str(tmp_path / "b.csv"))


def test_whole_panel_is_filled(spark):
    from tessera.queries import QUERIES
    from tessera.sources import views

    d = "/root/testdata/sf0.01"
    closes = views.panel(spark, d).select("datetime", "vt_symbol", "close").toPandas().pivot(index="datetime", columns="vt_symbol", values="close").sort_index()
    assert closes.shape[1] > 20
    held = closes.ffill().stack().dropna()
    out = QUERIES["bars_ffill_all"](spark, d).select("datetime", "vt_symbol", "close", "filled").toPandas().set_index(["datetime", "vt_symbol"]).sort_index()
    assert len(out) == len(held) and (out["close"].astype(float) - held.reindex(out.index)).abs().max() < 1e-3
    assert int((~out["filled"]).sum()) == int(closes.notna().sum().sum())


def test_close_matrix_of_every_symbol(spark):
    from tessera.queries import QUERIES
    from tessera.sources import views

    d = "/root/testdata/sf0.01"
    expected = {(r["datetime"], r["vt_symbol"]): r["close"] for r in views.panel(spark, d).collect()}
    out = [(r["datetime"], s, v) for r in QUERIES["pivot_close_all"](spark, d).collect() for s, v in zip(r["symbols"], r["values"], strict=True)]
    assert len(out) == len(expected) and all(expected[t, s] == v for t, s, v in out) and len({s for _, s, _ in out}) > 3
