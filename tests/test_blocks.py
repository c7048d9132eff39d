"""Ranks and quantiles over split series equal plain windows, wherever the blocks begin."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import blocks

SCHEMA = "series_id string, date date, value double, rank_in double, note array<string>"


def rows_of(seed, n=400):
    draw = np.random.default_rng(seed)
    rows = []
    for s, size in (("a", n), ("b", n // 3), (None, 5)):
        for i in range(size):
            v = None if draw.random() < 0.1 else float("nan") if draw.random() < 0.02 else float(np.round(draw.normal(), 1))
            rows.append((s, dt.date(2000, 1, 1) + dt.timedelta(days=3 * i), v, float(draw.normal()), [str(i)]))
    return rows


def values(rows, s, place=2):
    return [r[place] if r[place] is not None else float("nan") for r in rows if r[0] == s]


def found(df, *columns):
    out = {}
    for r in df.orderBy("series_id", "date").collect():
        out.setdefault(r.series_id, []).append(tuple(r[c] for c in columns))
    return out


def same(got, want):
    assert [x is None for x in got] == [x is None for x in want]
    assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None], rel=1e-9, abs=1e-12)


def plain_rank(x, window, least):
    out = []
    for i, v in enumerate(x):
        held = [y for y in x[max(0, i + 1 - window) : i + 1] if y == y]
        out.append(sum(y <= v for y in held) / len(held) if v == v and len(held) >= least else None)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of(1)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.mark.parametrize("window, least, size", [(1, 1, 7), (10, 4, 7), (60, 60, 50), (60, 8, 4096), (1000, 30, 16)])
def test_rolling_ranks(table, window, least, size):
    rows, df = table
    out = blocks.rolling_ranks(df, {"one": "value", "two": "rank_in"}, window, least, rows=size)
    assert out.columns == [*df.columns, "one", "two"]
    got = found(out, "one", "two", "note")
    for s in ("a", "b", None):
        same([g[0] for g in got[s]], plain_rank(values(rows, s), window, least))
        same([g[1] for g in got[s]], plain_rank(values(rows, s, 3), window, least))
        assert [g[2] for g in got[s]] == [[str(i)] for i in range(len(got[s]))]


@pytest.mark.parametrize("share, size", [(0.05, 13), (0.5, 100), (1.0, 64)])
def test_moving_quantiles(table, share, size):
    rows, df = table
    got = found(blocks.moving_quantile(df, "rank_in", 30, share, "q", rows=size), "q", "q_mean", "q_sd")
    gaps = found(blocks.moving_quantile(df, "value", 5, share, "q", rows=size), "q")
    for s in ("a", "b", None):
        x = np.array(values(rows, s, 3))
        frames = [x[i - 30 : i] if i >= 30 else None for i in range(len(x))]
        for k, f in enumerate((lambda v: np.quantile(v, share), np.mean, lambda v: np.std(v, ddof=1))):
            same([g[k] for g in got[s]], [None if v is None else f(v) for v in frames])
        y = np.array(values(rows, s))
        same([g[0] for g in gaps[s]], [np.quantile(y[i - 5 : i], share) if i >= 5 and not np.isnan(y[i - 5 : i]).any() else None for i in range(len(y))])


@pytest.mark.parametrize("share, include, least, size, buckets", [(0.5, True, 1, 16, 32), (0.05, False, 20, 7, 48), (0.0, True, 3, 30, 32), (1.0, False, 1, 5, 256), (0.9, True, 1, 4096, 256)])
def test_expanding_quantiles(table, share, include, least, size, buckets):
    rows, df = table
    out = blocks.expanding_quantile(df, "value", share, "q", include_current=include, least=least, rows=size, buckets=buckets)
    assert out.columns == [*df.columns, "q"]
    got = found(out, "q")
    for s in ("a", "b", None):
        x = values(rows, s)
        held = [[y for y in x[: i + include] if y == y] for i in range(len(x))]
        same([g[0] for g in got[s]], [np.quantile(h, share) if len(h) >= least else None for h in held])


def test_expanding_quantile_of_trends_and_ties(spark):
    """Values that rise, fall or repeat put whole blocks above, below or at one place of the slice."""
    day = lambda i: dt.date(1990, 1, 1) + dt.timedelta(days=i)
    shapes = {"up": lambda i: float(i), "down": lambda i: -float(i), "flat": lambda i: 3.0, "steps": lambda i: float(i // 50 % 3), "wave": lambda i: float(np.sin(i / 30) * i)}
    rows = [(s, day(i), f(i), 0.0, None) for s, f in shapes.items() for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for share in (0.02, 0.5, 0.97):
        got = found(blocks.expanding_quantile(df, "value", share, "q", rows=11, buckets=32), "q")
        for s in shapes:
            x = values(rows, s)
            same([g[0] for g in got[s]], [np.quantile(x[: i + 1], share) for i in range(len(x))])


def test_empty_and_positions(spark, table):
    rows, df = table
    none = df.limit(0)
    assert blocks.rolling_ranks(none, {"r": "value"}, 5).collect() == [] and blocks.expanding_quantile(none, "value", 0.5, "q").collect() == []
    got = found(blocks.positioned(df.withColumn("date", F.expr("date_add(date, 0)")), ["series_id"]), "__pos")
    assert all([g[0] for g in got[s]] == list(range(len(got[s]))) for s in got)


def test_ranks_cost_the_same_whatever_the_window():
    x = np.random.default_rng(0).normal(size=200_000)
    took = []
    for window in (100, 10_000):
        began = time.process_time()
        blocks.window_ranks(x, window, window)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.5


def test_one_long_series_is_many_tasks(spark):
    df = spark.range(60_000).select(F.concat(F.lit("s"), (F.col("id") % 1).cast("string")).alias("series_id"), F.expr("timestamp_seconds(id * 3600)").alias("date"), F.rand(1).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = blocks.expanding_quantile(df, "value", 0.5, "q").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.max(F.abs(F.col("q") - 0.5)).alias("e")).collect()
        assert len(out) == 4 and sum(r.n for r in out) == 60_000
        ranks = blocks.rolling_ranks(df, {"r": "value"}, 500).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
        assert len(ranks) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
