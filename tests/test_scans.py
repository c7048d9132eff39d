"""Filters over split series equal the plain folds, wherever the chunks begin."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import folds, scans

SCHEMA = "series_id string, date date, ret double, p double, confirms boolean, `odd name` int"


def rows_of(seed, n=300, series=("a", "b", None)):
    draw = np.random.default_rng(seed)
    day = lambda i: dt.date(2001, 1, 1) + dt.timedelta(days=int(i))
    return [(s, day(3 * i), float(draw.normal() * 0.01), float(draw.beta(0.4, 0.4)), bool(draw.random() < 0.5), i) for s in series for i in range(n - 7 * (s == "b"))]


def borders(seed, n=900):
    """A chunk number that rises at random days."""
    cuts = sorted(random.Random(seed).sample(range(n), 12))
    day = F.datediff("date", F.lit("2001-01-01"))
    return sum((F.when(day >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")


def by_series(df, *columns):
    out = {}
    for r in df.orderBy("series_id", "date").collect():
        out.setdefault(r.series_id, []).append(tuple(r[c] for c in columns))
    return out


def plain(rows, step, start, *inputs):
    """The fold of each series; `start` may depend on its first row."""
    places = {"ret": 2, "p": 3, "confirms": 4}
    out = {}
    for s in {r[0] for r in rows}:
        own = [tuple(r[places[c]] for c in inputs) for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1])]
        out[s] = folds.replay(step, start(own[0]) if callable(start) else start, own)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for s in got:
        assert np.array(got[s], float) == pytest.approx(np.array(want[s], float), rel=1e-9, abs=1e-12)


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of(1)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


P3 = ((0.95, 0.04, 0.01), (0.05, 0.90, 0.05), (0.02, 0.08, 0.90))
S3 = (0.003, 0.006, 0.014)


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_scans_equal_folds(table, seed):
    rows, df = table
    how = {} if seed is None else {"chunk": borders(seed)}
    same(by_series(scans.ewma_vol(df, 0.9, **how), "sigma"), plain(rows, folds.ewma_step(0.9), lambda r: r[0] ** 2, "ret"))
    same(by_series(scans.gjr_filter(df, 2e-6, 0.05, 0.1, 0.85, 1e-4, **how), "sigma"), plain(rows, folds.gjr_step(2e-6, 0.05, 0.1, 0.85), 1e-4, "ret"))
    same(by_series(scans.arma_residuals(df, 1e-4, 0.3, -0.6, **how), "eps"), plain(rows, folds.arma_step(1e-4, 0.3, -0.6), None, "ret"))
    stay = (0.97, 0.9)
    same(by_series(scans.hamilton_filter(df, "ret", stay, (0, 0.001), (0.005, 0.015), **how), "p_stress"), plain(rows, folds.hamilton_step(stay, (0, 0.001), (0.005, 0.015)), 0.03 / 0.13, "ret"))
    smooth = by_series(scans.kim_smoother(df, "ret", P3, (0.0,) * 3, S3, ("x", "y", "z"), **how), "x", "y", "z")
    for s, probs in by_series(scans.hamilton_states(df, "ret", P3, (0.0,) * 3, S3, ("x", "y", "z"), **how), "x", "y", "z").items():
        assert np.array(smooth[s]) == pytest.approx(folds.kim_smoother(np.array(probs), np.array(P3)), abs=1e-9)
        assert np.array(probs).sum(axis=1) == pytest.approx(1)


@pytest.mark.parametrize("seed", [None, 4, 5, 6])
def test_state_machine_equals_the_fold(table, seed):
    rows, df = table
    draw = random.Random(seed)
    confirm, dwell = draw.randint(1, 3), draw.randint(1, 7)
    how = {} if seed is None else {"chunk": borders(seed)}
    got = by_series(scans.anti_chattering(df, "p", enter=0.6, leave=0.35, confirm=confirm, dwell=dwell, **how), "stressed", "days_in", "derisk")
    assert got == plain(rows, folds.confirmed_step(0.6, 0.35, confirm, dwell, 0.5), (False, dwell, 0, 0), "p", "confirms")
    assert any(r[0] for r in got["a"]) and not all(r[0] for r in got["a"])


def test_probabilities_of_outliers_and_long_runs(spark):
    """Densities that underflow and products of many small numbers leave probabilities what they are."""
    rows = [("s", dt.date(2000, 1, 1) + dt.timedelta(days=i), 5.0 if i == 700 else 0.001, 0.5, True, i) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = by_series(scans.hamilton_filter(df, "ret", (0.97, 0.95), (0.0, 0.0), (0.004, 0.012)), "p_stress")["s"]
    assert all(0 <= p[0] <= 1 for p in got) and got[700][0] == pytest.approx(1) and got[-1][0] < 0.2


def test_missing_values_and_odd_rows(spark):
    rows = [("s", dt.date(2000, 1, 1), None, 0.5, None, 0), ("s", dt.date(2000, 1, 2), 0.02, 0.5, None, 1), ("s", dt.date(2001, 9, 3), float("nan"), 0.5, True, 2), ("s", dt.date(2001, 9, 4), 0.01, 0.5, True, 3), ("s", None, 0.03, 0.5, True, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    sigma = {r["odd name"]: r.sigma for r in scans.ewma_vol(df, first_var=1e-4).collect()}
    v = 0.94e-4 + 0.06 * 4e-4
    assert sigma == pytest.approx({0: 0.01, 1: 0.01, 2: v**0.5, 3: v**0.5, 4: (0.94 * v + 0.06 * 1e-4) ** 0.5})
    eps = {r["odd name"]: r.eps for r in scans.arma_residuals(df, 0.001, 0.5, 0.2).collect()}
    e1 = 0.02 - 0.001
    e3 = 0.01 - 0.001 - 0.5 * 0.02 - 0.2 * e1
    assert eps[0] is None and eps[2] is None and eps[1] == pytest.approx(e1) and eps[3] == pytest.approx(e3) and eps[4] == pytest.approx(0.029 - 0.5 * 0.01 - 0.2 * e3)
    assert {r["odd name"]: r.p_stress for r in scans.hamilton_filter(df.withColumnRenamed("p", "q"), "ret", (0.9, 0.9), (0, 0), (0.01, 0.02)).collect()}[0] == pytest.approx(0.5)
    with pytest.raises(Exception, match="a regime probability is missing"):
        scans.anti_chattering(df.withColumn("p", F.lit(None).cast("double")), "p").collect()
    assert scans.ewma_vol(df.limit(0)).collect() == [] and scans.anti_chattering(df.limit(0), "p").collect() == []


def test_one_series_runs_on_many_tasks_without_python(spark):
    df = spark.range(20_000).select(F.lit("s").alias("series_id"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("date"), (F.rand(3) - 0.5).alias("ret"), F.rand(4).alias("p"), F.lit(True).alias("confirms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (scans.ewma_vol(df), scans.anti_chattering(df, "p"), scans.hamilton_states(df, "ret", P3, (0.0,) * 3, S3, ("x", "y", "z"))):
            plan = out._jdf.queryExecution().toString()
            assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        parts = scans.ewma_vol(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4 and sum(r["count"] for r in parts) == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
