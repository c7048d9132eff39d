"""Interval joins, correlation matrices, components and breaks against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import calendar, panels, rolling, stats
from riskweave.plans import catalogue

DAY = dt.date(2003, 1, 1)


def test_interval_join_takes_all_overlapping_intervals(spark):
    draw = np.random.default_rng(1)
    rows = [(int(k), DAY + dt.timedelta(days=int(draw.integers(0, 900))), "row") for k in range(300)] + [(-1, None, "row")]
    spans = [(int(k), DAY + dt.timedelta(days=int(a)), DAY + dt.timedelta(days=int(a + n)), "span") for k, (a, n) in enumerate(zip(draw.integers(-50, 900, 200), draw.choice([-3, 0, 1, 63, 64, 700], 200)))]
    spans += [(200, None, DAY, "span"), (201, DAY, None, "span")]
    df, iv = spark.createDataFrame(rows, "k int, date date, note string"), spark.createDataFrame(spans, "span int, start date, end date, note string")
    for days in (7, 64):
        got = {(r.k, r.span, r.note) for r in calendar.interval_join(df, iv, days=days).collect()}
        assert got == {(k, s, "row") for k, d, _ in rows for s, a, b, _ in spans if d and a and b and a <= d <= b} and len(got) > 1000
    own = calendar.interval_join(df.withColumn("g", F.col("k") % 3), iv.withColumn("g", F.col("span") % 3), keys=["g"])
    assert {(r.k, r.span) for r in own.collect()} == {(k, s) for k, s, _ in got if k % 3 == s % 3}
    assert calendar.interval_join(df, iv.limit(0)).collect() == []


def test_more_intervals_than_a_broadcast_takes(spark):
    """Beyond the former bound of 10,000, over days and over single moments."""
    start = F.timestamp_seconds(F.col("id") * 600)
    iv = spark.range(120_000).select(F.col("id").alias("span"), start.alias("start"), (start + F.expr("interval 30 minutes")).alias("end"))
    at = spark.range(3000).select(F.timestamp_seconds(F.col("id") * 24_000 + 1).alias("date"))
    found = calendar.interval_join(at, iv, days=1)
    assert found.count() == sum(min(3, 24_000 * k // 600 + 1) for k in range(3000) if 24_000 * k // 600 < 120_000)


def panel_of(seed, n_series, n_days):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n_days, n_series)) + draw.normal(size=(n_days, 1)) + 1e6
    x[draw.random(x.shape) < 0.3] = np.nan
    x[:, 0] = 5.0
    return x


@pytest.mark.parametrize("series, days", [(512, 1024), (4, 20)])
def test_correlations_of_all_pairs(spark, series, days):
    x = panel_of(2, 15, 120)
    rows = [(f"s{k:02}é", DAY + dt.timedelta(days=t), None if np.isnan(v) and t % 2 else float(v)) for t, line in enumerate(x) for k, v in enumerate(line)]
    rows += [(None, DAY, 1.0), ("s01é", None, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, date date, value double")
    got = {(r.a, r.b): (r.n, r.corr) for r in panels.correlations(df, least=10, series=series, days=days).collect()}
    assert len(got) == 15 * 14 // 2
    for a in range(15):
        for b in range(a + 1, 15):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            n, corr = got[f"s{a:02}é", f"s{b:02}é"]
            assert n == both.sum() and (corr is None if a == 0 else corr == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-7))


def test_correlations_of_odd_panels(spark):
    schema = "series_id string, date date, value double"
    assert panels.correlations(spark.createDataFrame([], schema)).collect() == []
    twice = [("a", DAY + dt.timedelta(days=t), float(v)) for t in range(4) for v in (t, t + 2)] + [("b", DAY + dt.timedelta(days=t), float(t * t)) for t in range(4)]
    got = panels.correlations(spark.createDataFrame(twice, schema)).first()
    assert got.n == 4 and got["corr"] == pytest.approx(np.corrcoef(np.arange(4) + 1, np.arange(4) ** 2)[0, 1])

def shuffled_rows(df):
    """Rows that the exchanges of a plan that has run have written."""
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_correlations_shuffle_series_and_not_pairs(spark):
    """300 series over 30 days have 44,850 pairs; only what the panel's own 9,000 rows make crosses the network."""
    df = spark.range(9000).selectExpr("concat('s', id % 300) AS series_id", "date_add(DATE'2003-01-01', CAST(id / 300 AS INT)) AS date", "CAST(hash(id) AS DOUBLE) AS value")
    out = panels.correlations(df, series=16, days=8)
    assert len(out.collect()) == 300 * 299 // 2
    assert shuffled_rows(out) < 300 * 299 // 2


@pytest.mark.parametrize("cells, series", [(1, 4), (1, 64), (1 << 22, 4)])
def test_correlations_by_chunks_of_days_and_by_tiles(spark, monkeypatch, cells, series):
    """Series that begin and end in different chunks of days, compared chunk by chunk and all days at once."""
    monkeypatch.setattr(panels, "CELLS", cells)
    x = panel_of(4, 40, 100)
    for k in range(40):
        x[: k, k], x[100 - 2 * (k % 9) :, k] = np.nan, np.nan
    rows = [(f"s{k}", DAY + dt.timedelta(days=t), float(v)) for t, line in enumerate(x) for k, v in enumerate(line) if not np.isnan(v)]
    got = panels.correlations(spark.createDataFrame(rows, "series_id string, date date, value double"), least=25, series=series, days=7).collect()
    found = {(r.a, r.b): (r.n, r.corr) for r in got}
    expected = {}
    for a in range(40):
        for b in range(a + 1, 40):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if both.sum() >= 25:
                expected[tuple(sorted((f"s{a}", f"s{b}")))] = (both.sum(), None if a == 0 else np.corrcoef(x[both, a], x[both, b])[0, 1])
    assert len(got) == len(found) and found.keys() == expected.keys() and len(expected) > 300
    for pair, (n, corr) in expected.items():
        assert found[pair][0] == n and found[pair][1] == (None if corr is None else pytest.approx(corr, abs=1e-7))


@pytest.mark.parametrize("rows", [16, 4096])
def test_component_of_many_columns_is_that_of_svd(spark, rows):
    x = panel_of(3, 5, 150)[:, 1:]
    names = ["p", "q", "r", "s"]
    data = [("one", DAY + dt.timedelta(days=t), *[None if np.isnan(v) else float(v) for v in line]) for t, line in enumerate(x)]
    df = spark.createDataFrame(data, "series_id string, date date, " + ", ".join(f"{c} double" for c in names))
    got = [r.pc1 for r in rolling.first_component(df, names, 40, 8, anchor="r", rows=rows).orderBy("date").collect()]
    whole = np.isfinite(x).all(axis=1)
    for t in range(len(x)):
        block = x[max(0, t - 39) : t + 1][whole[max(0, t - 39) : t + 1]]
        if not whole[t] or len(block) < 8:
            assert got[t] is None
            continue
        z = (block - block.mean(axis=0)) / block.std(axis=0, ddof=1)
        load = np.linalg.svd(z, full_matrices=False)[2][0]
        assert got[t] == pytest.approx(float(z[-1] @ load) * (1 if load[2] >= 0 else -1), abs=1e-5)


def test_component_query_is_that_of_svd(spark):
    from riskweave.plans.base_queries import SEGMENTS, segment_returns

    sf = "/root/testdata/sf0.001"
    got = {r.date: r.pc1 for r in catalogue.QUERIES["rolling_pc1_panel"](spark, sf).collect()}
    wide = segment_returns(spark, sf).toPandas().pivot(index="date", columns="series_id", values="ret")[SEGMENTS]
    x, dates = wide.to_numpy(float), list(wide.index)
    whole = np.isfinite(x).all(axis=1)
    for t in range(0, len(x), 97):
        block = x[max(0, t - 59) : t + 1][whole[max(0, t - 59) : t + 1]]
        if whole[t] and len(block) >= 40:
            z = (block - block.mean(axis=0)) / block.std(axis=0, ddof=1)
            load = np.linalg.svd(z, full_matrices=False)[2][0]
            assert got[dates[t]] == pytest.approx(float(z[-1] @ load) * (1 if load[0] >= 0 else -1), abs=1e-5)
        else:
            assert got[dates[t]] is None


def test_breaks_are_those_of_one_search(spark):
    draw = np.random.default_rng(4)
    shapes = {
        "calm": draw.normal(size=400),
        "two": np.concatenate([draw.normal(size=300), 4 * draw.normal(size=200), 0.5 * draw.normal(size=900)]),
        "zero": np.zeros(100),
        "short": draw.normal(size=12),
        "many": np.concatenate([draw.normal(size=120) * s for s in (1, 5, 1, 6, 1, 9, 2)]),
    }
    rows = [(s, DAY + dt.timedelta(days=2 * t), float(v)) for s, x in shapes.items() for t, v in enumerate(x)] + [("two", DAY + dt.timedelta(days=9999), None)]
    found = {}
    for r in rolling.icss_breaks(spark.createDataFrame(rows, "series_id string, date date, ret double")).collect():
        found.setdefault(r.series_id, []).append((r.date - DAY).days // 2)
    want = {s: stats.icss(x * x) for s, x in shapes.items()}
    assert {s: sorted(v) for s, v in found.items()} == {s: v for s, v in want.items() if v} and len(want["many"]) >= 5
