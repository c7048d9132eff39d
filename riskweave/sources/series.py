"""Series sources: the bridge from the star-schema tables to long series (series_id, date, value), and readers
for the files a time-series desk has."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import require
from ..operators import calendar, quality

#: The column that says when a row of a table was known.
KNOWN_AT = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
_AS_OF: ContextVar[str | None] = ContextVar("as_of", default=None)


@contextmanager
def as_of(date: str | None) -> Iterator[None]:
    """Tables that are read inside are cut at `date`, so that nothing computed from them has seen later rows."""
    token = _AS_OF.set(date)
    try:
        yield
    finally:
        _AS_OF.reset(token)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    day = _AS_OF.get()
    if day and name in KNOWN_AT:
        df = df.where(F.col(KNOWN_AT[name]) < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp"))
    return df


def _series(df: DataFrame, series: Column, date: Column, value: Column) -> DataFrame:
    return df.groupBy(series.alias("series_id"), date.cast("date").alias("date")).agg(value.alias("value"))


def orders_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strictly positive daily level."""
    o = read_table(spark, sf_dir, "orders")
    return _series(o, F.lit("orders"), F.col("o_orderdate"), F.round(F.avg("o_totalprice") / 1e5 + 3e-10, 6))


def segment_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by market segment, each on its own irregular calendar."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    both = o.select("o_custkey", "o_orderdate", "o_totalprice").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return _series(both, F.col("c_mktsegment"), F.col("o_orderdate"), F.round(F.avg("o_totalprice") / 1e5 + 3e-10, 6))


def order_days(spark: SparkSession, sf_dir: str, segments: dict[str, str]) -> DataFrame:
    """(series_id, date, value, a column for each segment): the daily level and those of some segments, in one pass."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    both = o.select("o_custkey", "o_orderdate", "o_totalprice").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    level = lambda x: F.round(F.avg(x) / 1e5 + 3e-10, 6)
    own = [level(F.when(F.col("c_mktsegment") == segment, F.col("o_totalprice"))).alias(name) for name, segment in segments.items()]
    return both.groupBy(F.lit("orders").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(level("o_totalprice").alias("value"), *own)


def ship_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return _series(li, F.lit("ship"), F.col("l_shipdate"), F.round(F.avg("l_extendedprice") + 3e-8, 4))


def ship_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return _series(li, F.lit("vix"), F.col("l_shipdate"), F.count("*").cast("double"))


def monthly_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped at the month's first day, as published monthly series are."""
    o = read_table(spark, sf_dir, "orders")
    return _series(o, F.lit("monthly"), F.trunc("o_orderdate", "MM"), F.round(F.avg("o_totalprice") / 1e5 + 3e-10, 6))


def weekly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return _series(e, F.col("event_type"), F.date_trunc("week", "ts"), F.round(F.avg("value") + 3e-10, 6))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number hourly means, which have runs of equal values."""
    e = read_table(spark, sf_dir, "events")
    hour = e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("date"))
    return hour.agg(F.round(F.round(F.avg("value") + 3e-10, 6) / 20, 0).alias("value"))


def wide(series: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Outer-joined on the date, one column a series, nothing filled; of values that share a date the least counts."""
    return series.groupBy("date").pivot("series_id", ids).agg(F.min("value"))


def checked_ids(ids: Iterable[str], universe: Iterable[str] | None = None, discontinued: Iterable[str] = ()) -> list[str]:
    """The ids, unless one of them is discontinued or not in the universe."""
    ids = list(ids)
    if refused := sorted(set(ids) & set(discontinued)):
        raise ValueError(f"discontinued series: {', '.join(refused)}")
    if universe is not None and (unknown := sorted(set(ids) - set(universe))):
        raise ValueError(f"unknown series: {', '.join(unknown)}")
    return ids


#: (id, first day, last day) -> (date, value); for prices (id, first day, day after the last) -> the vendor's frame.
Fetch = Callable[[str, str, str], DataFrame]


def fetch_levels(ids: Iterable[str], start: str, end: str, fetch: Fetch, lags: dict[str, int] | None = None, universe: Iterable[str] | None = None, discontinued: Iterable[str] = ()) -> DataFrame:
    """Long series from a vendor, nothing filled. A series that is published late is asked for from so many days
    before `start`, and its values are dated when they were known; the slice [start, end] is cut afterwards."""
    parts = []
    for name in checked_ids(ids, universe, discontinued):
        lag = (lags or {}).get(name, 0)
        got = fetch(name, (dt.date.fromisoformat(start) - dt.timedelta(lag)).isoformat(), end)
        series = got.select(F.lit(name).alias("series_id"), F.to_date("date").alias("date"), F.col("value").cast("double").alias("value"))
        parts.append(calendar.slice_dates(calendar.publication_lag(series, lag), start, end))
    if not parts:
        raise ValueError("no series asked for")
    return functools.reduce(DataFrame.unionByName, parts)


def fetch_prices(tickers: Iterable[str], start: str, end: str, fetch: Fetch, universe: Iterable[str] | None = None) -> DataFrame:
    """Adjusted prices from a vendor whose last day is exclusive: it is asked for a day more. Runs of unchanged
    prices become NULL but for their first; a ticker that shows monthly coupon drops is unadjusted and fails."""
    parts = []
    for name in checked_ids(tickers, universe):
        got = adjusted_close(fetch(name, start, (dt.date.fromisoformat(end) + dt.timedelta(1)).isoformat()))
        parts.append(calendar.slice_dates(got.select(F.lit(name).alias("series_id"), "date", F.col("price").alias("value")), start, end))
    if not parts:
        raise ValueError("no tickers asked for")
    masked = quality.mask_stale(functools.reduce(DataFrame.unionByName, parts)).drop("masked")
    drops = quality.coupon_drops(masked.where("value IS NOT NULL")).select("series_id", "flagged")
    joined = masked.join(drops, "series_id", "left")
    return require(joined, ~F.coalesce("flagged", F.lit(False)), "prices show monthly coupon drops: they look unadjusted").drop("flagged")


def read_series(spark: SparkSession, path: str, fmt: str = "parquet", ids: list[str] | None = None, start: str | None = None, end: str | None = None, discontinued: tuple[str, ...] = (), universe: Iterable[str] | None = None) -> DataFrame:
    """Scan a long series table. Discontinued ids, and ids outside the universe where one is given, are refused. The
    date slice is closed and reaches the scan."""
    checked_ids(ids or (), universe, discontinued)
    reader = spark.read.option("header", True).schema("series_id string, date date, value double") if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    if ids:
        df = df.where(F.col("series_id").isin(ids))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.select("series_id", "date", "value")


def adjusted_close(vendor: DataFrame) -> DataFrame:
    """(date, price): the adjusted close where the vendor's frame has one, else the close."""
    names = {c.lower().replace(" ", "").replace("_", ""): c for c in vendor.columns}
    picks = [F.col(f"`{names[k]}`") for k in ("adjclose", "close") if k in names]
    if not picks:
        raise ValueError("the frame has neither an adjusted close nor a close")
    return vendor.select(F.to_date(f"`{names['date']}`").alias("date"), F.coalesce(*picks).cast("double").alias("price"))


def read_monthly_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("date", "gz_spread", "ebp"), lag_days: int = 45) -> DataFrame:
    """A monthly file with a publication date: column names in any case, values that aren't numbers NULL,
    a date that occurs twice an error."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    values = [F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in required if c != "date"]
    df = raw.select(F.to_date("date").alias("date"), *values).withColumn("publication_date", F.date_add(F.last_day("date"), lag_days))
    from pyspark.sql import Window

    counted = df.withColumn("times", F.count("*").over(Window.partitionBy("date")))
    return require(counted, F.col("times") == 1, "a date occurs twice").drop("times")


def read_default_rates(spark: SparkSession, path: str, asof: str) -> DataFrame:
    """Bitemporal: what had been observed by `asof`; for each date the latest report and its source, of reports of one
    day the first source's by name."""
    raw = spark.read.option("header", True).schema("date date, default_rate double, source string, observation_date date").csv(path)
    known = raw.where(F.col("observation_date") <= F.lit(asof).cast("date"))
    from pyspark.sql import Window

    newest = known.withColumn("newest", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("observation_date"), "source", "default_rate")))
    return newest.where("newest = 1").select("date", "default_rate", "source", "observation_date")


def read_panel_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("date", "sigma_ebp", "sigma_oas", "ebp_level", "oas_level", "default_proxy")) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(F.to_date("date").alias("date"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in required if c != "date"])
