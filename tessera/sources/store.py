"""Bars, factors, signals, membership and models on disk, and readers for CSV and database tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.operators.relational import in_range, overview, padded_range, upsert

BARS = "datetime timestamp_ntz, vt_symbol string, open double, high double, low double, close double, volume double, turnover double, open_interest double"
#: Headers that stand for one column; the first that a file has is taken.
ALIASES = {
    "vt_symbol": ("symbol", "vt_symbol", "code"), "datetime": ("bob", "datetime", "time", "date"), "open": ("open", "open_price"), "high": ("high", "high_price"),
    "low": ("low", "low_price"), "close": ("close", "close_price"), "volume": ("volume", "vol"), "turnover": ("amount", "turnover"),
}
DAILY = ("open", "high", "low", "close", "preclose", "volume", "amount", "adjustflag", "turn", "tradestatus", "pctChg", "peTTM", "pbMRQ", "psTTM", "pcfNcfTTM", "isST")


def parse_time(text):
    """Timestamps written as yyyy-MM-dd[ HH:mm:ss], yyyyMMdd or ISO; null if none of them."""
    day = F.expr("try_to_timestamp({0}, 'yyyyMMdd')".replace("{0}", f"`{text}`"))
    return F.when(F.col(text).contains("-"), F.expr(f"try_cast(`{text}` AS timestamp_ntz)")).otherwise(day.cast("timestamp_ntz"))


def read_bar_csv(spark: SparkSession, path) -> DataFrame:
    """Bars from CSV files with any of the known headers. Files without a symbol or a time column are an error; volume and
    turnover default to 0; numbers that do not parse are null."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    found = {name: next((a for a in aliases if a in raw.columns), None) for name, aliases in ALIASES.items()}
    for name in ("vt_symbol", "datetime"):
        if found[name] is None:
            raise ValueError(f"no column for {name}: one of {', '.join(ALIASES[name])}")
    number = lambda n: F.expr(f"try_cast(`{found[n]}` AS double)") if found[n] else F.lit(None).cast("double")
    zero = lambda n: F.coalesce(number(n), F.lit(0.0))
    return raw.select(parse_time(found["datetime"]).alias("datetime"), F.col(found["vt_symbol"]).alias("vt_symbol"), *(number(n).alias(n) for n in ("open", "high", "low", "close")), zero("volume").alias("volume"), zero("turnover").alias("turnover"))


def read_daily_csv(spark: SparkSession, path, with_st: bool = True) -> DataFrame:
    """Daily bars with fundamentals, one known layout, byte order mark allowed; blank numbers are 0; only days that trade."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    out = raw.select(F.to_date("date").alias("date"), "code", *(F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)).alias(c) for c in DAILY))
    out = out.where("tradestatus = 1")
    return out if with_st else out.where("isST = 0")


def read_sqlite(path: str, spark: SparkSession, symbols: Sequence[str] = (), frequency: str | None = None, start=None, end=None, batch: int = 50_000) -> DataFrame:
    """Bars of a replay database, selected by parameterised SQL, through pandas in batches on the driver: for small files."""
    import sqlite3

    import pandas as pd

    where, args = [], []
    for clause, value in (("frequency = ?", frequency), ("bob >= ?", start), ("bob <= ?", end)):
        if value is not None:
            where.append(clause)
            args.append(value)
    if symbols:
        where.append(f"symbol IN ({', '.join('?' * len(symbols))})")
        args += symbols
    sql = "SELECT symbol, bob, open, high, low, close, volume, amount, frequency FROM bar_data" + (f" WHERE {' AND '.join(where)}" if where else "") + " ORDER BY bob, symbol"
    schema = "symbol string, bob string, open double, high double, low double, close double, volume double, amount double, frequency string"
    out = spark.createDataFrame([], schema)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for part in pd.read_sql_query(sql, db, params=args, chunksize=batch):
            out = out.unionByName(spark.createDataFrame(part.where(part.notna(), None), schema))
    return out


class BarStore:
    """A workspace: bars by interval, membership, contract settings, features, signals and models under one folder."""

    INTERVALS = ("1m", "1h", "d", "w")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self.fs = self._fs_path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def _replace(self, name: str, df: DataFrame, *by: str) -> None:
        """Writes next to the old table, then swaps; the old one stays readable until then."""
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}.new")
        self.fs.delete(self._fs_path(name), True)
        self.fs.mkdirs(self._fs_path(name).getParent())
        if not self.fs.rename(self._fs_path(f"{name}.new"), self._fs_path(name)):
            raise OSError(f"cannot move {name}.new into place")

    def save_bars(self, bars: DataFrame, interval: str = "d") -> None:
        """Upserts bars by (datetime, vt_symbol); the new row wins."""
        if interval not in self.INTERVALS:
            raise ValueError(f"interval must be one of {self.INTERVALS}")
        old = self._read(f"bars/{interval}")
        self._replace(f"bars/{interval}", upsert(old, bars, ["datetime", "vt_symbol"]) if old is not None else bars.dropDuplicates(["datetime", "vt_symbol"]))

    def load_bars(self, interval: str = "d", symbols: Sequence[str] = (), start=None, end=None) -> DataFrame:
        bars = self._read(f"bars/{interval}")
        if bars is None:
            return self.spark.createDataFrame([], BARS)
        return in_range(bars.where(F.col("vt_symbol").isin(*symbols)) if symbols else bars, start, end)

    def research_panel(self, interval: str, start, end, extended_days: int = 0, symbols: Sequence[str] = ()) -> DataFrame:
        """Bars of a padded range with vwap; prices over the symbol's first close in the range; suspended rows are NaN."""
        bars = padded_range(self.load_bars(interval, symbols), start, end, extended_days)
        prices = ("open", "high", "low", "close", "vwap")
        out = bars.withColumn("vwap", F.when(F.col("volume") != 0, F.col("turnover") / F.col("volume")))
        first = F.first("close").over(W.partitionBy("vt_symbol").orderBy("datetime").rowsBetween(W.unboundedPreceding, W.currentRow))
        idle = F.coalesce(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("open", "high", "low", "close", "volume", "turnover", "open_interest")), F.lit(0.0)) == 0, F.lit(False))
        out = out.withColumns({"_first": first, "_idle": idle})
        scaled = {c: F.when(F.col("_idle"), F.lit(float("nan"))).otherwise(F.when(F.col("_first") != 0, F.col(c) / F.col("_first"))) for c in prices}
        return out.withColumns(scaled).drop("_first", "_idle")

    def overview(self, interval: str = "d") -> DataFrame:
        return overview(self.load_bars(interval))

    def delete_bars(self, interval: str, symbols: Sequence[str]) -> None:
        self._replace(f"bars/{interval}", self.load_bars(interval).where(~F.col("vt_symbol").isin(*symbols)))

    def save_members(self, index: str, members: DataFrame) -> None:
        """``members(date, vt_symbol)``: days that are saved again are replaced."""
        old = self._read(f"members/{index}")
        kept = members if old is None else old.join(members.select("date").distinct(), "date", "left_anti").unionByName(members)
        self._replace(f"members/{index}", kept)

    def load_members(self, index: str, start=None, end=None) -> DataFrame:
        found = self._read(f"members/{index}")
        return in_range(found, start, end, "date") if found is not None else self.spark.createDataFrame([], "date date, vt_symbol string")

    def save_table(self, kind: str, name: str, df: DataFrame) -> None:
        """A named dataset, feature table or signal frame."""
        self._replace(f"{kind}/{name}", df)

    def load_table(self, kind: str, name: str) -> DataFrame | None:
        return self._read(f"{kind}/{name}")

    def list_tables(self, kind: str) -> list[str]:
        at = self._fs_path(kind)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at) if not f.getPath().getName().endswith(".new")) if self.fs.exists(at) else []

    def remove_table(self, kind: str, name: str) -> bool:
        return bool(self.fs.delete(self._fs_path(f"{kind}/{name}"), True))

    def save_contracts(self, settings: Mapping[str, tuple[float, float, float, float]]) -> None:
        """``vt_symbol: (long_rate, short_rate, size, pricetick)``."""
        rows = [(s, *map(float, v)) for s, v in settings.items()]
        new = self.spark.createDataFrame(rows, "vt_symbol string, long_rate double, short_rate double, size double, pricetick double")
        old = self._read("contracts")
        self._replace("contracts", new if old is None else upsert(old, new, ["vt_symbol"]))

    def load_contracts(self) -> DataFrame | None:
        return self._read("contracts")


class FactorStore:
    """One table for each factor: ``(trade_date, symbol, <factor>)``, both keys given, rows there."""

    def __init__(self, store: BarStore):
        self.store = store

    def save(self, name: str, df: DataFrame) -> None:
        if not {"trade_date", "symbol"} <= set(df.columns):
            raise ValueError("a factor needs trade_date and symbol")
        if df.where("trade_date is null or symbol is null").limit(1).count() or df.limit(1).count() == 0:
            raise ValueError("a factor needs rows, all with trade_date and symbol")
        self.store.save_table("factors", name, df)

    def append(self, name: str, df: DataFrame) -> None:
        old = self.store.load_table("factors", name)
        self.save(name, df if old is None else upsert(old, df, ["trade_date", "symbol"]))

    def load(self, name: str, start=None, end=None, symbols: Sequence[str] = ()) -> DataFrame | None:
        out = self.store.load_table("factors", name)
        if out is None:
            return None
        out = out.where(F.col("symbol").isin(*symbols)) if symbols else out
        for bound, keep in ((start, F.col("trade_date") >= F.lit(start)), (end, F.col("trade_date") <= F.lit(end))):
            out = out.where(keep) if bound else out
        return out

    def exists(self, name: str) -> bool:
        return name in self.names()

    def names(self) -> list[str]:
        return self.store.list_tables("factors")

    def delete(self, name: str) -> bool:
        return self.store.remove_table("factors", name)

    def merge(self, names: Sequence[str]) -> DataFrame:
        """The inner join of several factors by date and symbol."""
        out = None
        for n in names:
            one = self.load(n)
            if one is None:
                raise ValueError(f"no factor {n!r}")
            out = one if out is None else out.join(one, ["trade_date", "symbol"])
        return out
