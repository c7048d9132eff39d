"""The series engine: known values, no look-ahead, and SQL on the smallest tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import dist
from riskweave.operators import calendar as cal
from riskweave.operators import folds, models, quality, returns, risk, rolling, signals, stats, volatility
from riskweave.plans import catalogue
from riskweave.plans import reports
from riskweave.plans.reports import DiagnosticFailure, gate, gated, markdown
from riskweave.sources import cache
from tests.compare import compare, connect

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)
#: A cross-section on larger tables; all queries with SQL run on the smallest ones.
QUICK = ["coverage_report", "validate_series_issues", "asof_weekly_to_daily", "calendar_union_ffill", "mask_stale_runs", "variance_ratio_lm", "hamilton_filter_fixed", "dislocation_history", "christoffersen_ind_cc", "anti_chattering_states", "overlay_books", "walk_forward_ewma"]


def series(spark, values, name="s", column="value"):
    return spark.createDataFrame([(name, DAY + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], f"series_id string, date date, {column} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


@pytest.mark.parametrize("name", QUICK)
def test_oracles(spark, name):
    assert compare(spark, connect(SF), catalogue.QUERIES[name], catalogue.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_all_oracles(spark, name):
    assert compare(spark, connect(SMALL), catalogue.QUERIES[name], catalogue.ORACLES[name], SMALL) == ""


def test_rolling_rank_and_hysteresis(spark):
    ranks = column(rolling.percentile_rank(series(spark, [10, 20, 30, 40, 50, 1000, 2000]), 5), "rank")
    assert ranks[:4] == [None] * 4 and ranks[4] == 1.0
    flags = column(folds.hysteresis(series(spark, [0.20, 0.70, 0.45, 0.25, 0.65]), "value", 0.6, 0.3), "active")
    assert flags == [False, True, True, False, True]


def test_forward_returns_and_episodes(spark):
    fwd = column(returns.forward_returns(series(spark, [0.01] * 8, column="ret"), 3), "fwd_3")
    assert fwd[0] == pytest.approx(1.01**3 - 1) and fwd[5:] == [None] * 3
    active = [2 <= i <= 5 or 10 <= i <= 13 or 60 <= i <= 63 for i in range(80)]
    df = series(spark, range(80)).withColumn("active", F.expr("day(date) > 0")).drop("active")
    flags = spark.createDataFrame([("s", DAY + dt.timedelta(i), a) for i, a in enumerate(active)], "series_id string, date date, active boolean")
    assert rolling.independent_episodes(flags, 40).first().n_episodes == 2 and df.count() == 80


def test_quality_screens(spark):
    assert quality.longest_zero_run(series(spark, np.cumsum([1, 0, 0, 0, 2, -1, 0, 0, 3, 1]))).first().longest == 3
    masked = column(quality.mask_stale(series(spark, [1, 2, 2, 3, 4, 4, 4, 4, 5])), "value")
    assert masked == [1, 2, 2, 3, 4, None, None, None, 5]
    cov = quality.coverage(series(spark, [1, None, 2, 3]), "2023-12-22").first()
    assert (cov.n_raw, cov.n_obs, cov.pct_nan, cov.history_gap_days) == (4, 3, 25.0, 10)
    with pytest.raises(ValueError):
        quality.check_lag(0, weekly=True, weekday=4)


def test_publication_and_asof(spark):
    m = spark.createDataFrame([("m", dt.date(2020, 1, 1), 1.0)], "series_id string, date date, value double")
    assert m.select(cal.publication_date().alias("p")).first().p == dt.date(2020, 3, 16)
    left = series(spark, range(5)).select("date", "value")
    right = spark.createDataFrame([(DAY + dt.timedelta(1), 7.0), (DAY + dt.timedelta(3), 9.0)], "date date, w double")
    assert column(cal.asof_join(left, right, ["w"]), "w") == [None, 7.0, 7.0, 9.0, 9.0]


def test_var_backtests(spark):
    hit = spark.createDataFrame([("s", DAY + dt.timedelta(i), int(i < 10)) for i in range(250)], "series_id string, date date, hit int")
    lr = risk.kupiec(hit, 0.01).first().lr_uc
    assert lr == pytest.approx(-2 * (240 * math.log(0.99) + 10 * math.log(0.01) - 240 * math.log(0.96) - 10 * math.log(0.04)))
    c = risk.christoffersen(spark.createDataFrame([("s", DAY + dt.timedelta(i), int(200 <= i <= 209)) for i in range(1000)], "series_id string, date date, hit int")).first()
    assert (c.n11, c.n01) == (9, 1) and c.lr_ind > 20
    zones = spark.createDataFrame([(4,), (5,), (9,), (10,)], "x int").select(risk.basel_zone(F.col("x")).alias("z"))
    assert [r.z for r in zones.collect()] == ["green", "yellow", "yellow", "red"]


def test_folds_by_hand():
    r = [0.01, -0.02, 0.015]
    v = [1e-4]
    for x in r:
        v.append(1e-6 + (0.05 + 0.1 * (x < 0)) * x * x + 0.85 * v[-1])
    got = folds.replay(folds.gjr_step(1e-6, 0.05, 0.1, 0.85), 1e-4, [(x,) for x in r])
    assert [g[0] for g in got] == pytest.approx([math.sqrt(x) for x in v[:3]])
    assert volatility.gjr_variance(np.array(r), 1e-6, 0.05, 0.1, 0.85, 1e-4) == pytest.approx(v)
    path = folds.replay(folds.confirmed_step(0.7, 0.3, 2, 5, 0.5), (False, 5, 0, 0), [(p, True) for p in [0.8, 0.8, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]])
    # confirmed on the second day; the stay of five days binds before calm returns
    assert [s[0] for s in path] == [False, True, True, True, True, True, False, False]


@pytest.mark.parametrize("f", [lambda s: rolling.percentile_rank(s, 10), lambda s: rolling.expanding_median(s, "value", "rank"), lambda s: rolling.rolling_std(s, 10, "value", "rank")])
def test_no_look_ahead(spark, f):
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(0, 0.1, 60))
    shuffled = np.concatenate([x[:40], rng.permutation(x[40:])])
    a, b = column(f(series(spark, x)), "rank"), column(f(series(spark, shuffled)), "rank")
    assert a[:40] == b[:40] == column(f(series(spark, x[:40])), "rank")


def test_economic_metrics(spark):
    r = [0.01, -0.02, 0.03, 0.01, -0.01]
    df = spark.createDataFrame([("s", DAY + dt.timedelta(i), v, 1.0) for i, v in enumerate(r)], "series_id string, date date, strat_ret double, weight double")
    m = signals.economic_metrics(df).first()
    e = np.cumprod(1 + np.array(r))
    assert m.ann_return == pytest.approx(e[-1] ** (252 / 5) - 1) and m.max_drawdown == pytest.approx((e / np.maximum.accumulate(e) - 1).min())
    assert m.max_drawdown_duration == 1 and m.hit_rate == pytest.approx(0.6) and m.ann_turnover == 0


def test_distributions():
    assert dist.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709) and dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and dist.chi2_sf(12.591587243743977, 6) == pytest.approx(0.05)
    assert dist.skewt_cdf(0.3, 6, 0.0) == pytest.approx(dist.t_cdf(0.3 * math.sqrt(6 / 4), 6))
    assert dist.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-3)


def test_chow_lin_keeps_the_monthly_means():
    rng = np.random.default_rng(3)
    month = np.repeat(np.arange(6), 21)
    x = np.column_stack([np.ones(126), rng.normal(size=126).cumsum()])
    y = rng.normal(size=6)
    path, _ = models.chow_lin(y, x, month)
    assert np.allclose([path[month == m].mean() for m in range(6)], y, atol=1e-8)


def test_small_series_helpers(spark):
    s = series(spark, [1, None, 3, 2, 5], column="value")
    assert column(rolling.forward_fill(s, "value"), "value") == [1, 1, 3, 2, 5]
    rho = stats.lag_one_correlation(series(spark, [1, 2, 4, 3, 5], column="ret")).first().rho1
    assert rho == pytest.approx(np.corrcoef([1, 2, 4, 3], [2, 4, 3, 5])[0, 1])


def test_unit_root_tests():
    rng = np.random.default_rng(2)
    noise = rng.normal(size=400)
    assert stats.adf(noise)[1] < 0.01 and stats.adf(noise.cumsum())[1] > 0.1
    assert stats.kpss(noise)[1] >= 0.05 > stats.kpss(noise.cumsum())[1]


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    tag = {"s": cache.fingerprint("level", "s", 1, "d"), "t": "x"}
    assert not cache.write_cache(series(spark, [1, 2, 3]), path, tag).first().revised
    cache.write_cache(series(spark, [5], "t"), path, tag)
    assert cache.load_cached(spark, path, ["s"]).count() == 3
    assert cache.write_cache(series(spark, [1, 2, 4]), path, tag).first().revised

    def down():
        raise OSError("no network")

    assert cache.fetch_or_stale(down, spark, path, "s", "2024-01-01", "2024-01-05", 5).count() == 3
    with pytest.raises(OSError):
        cache.fetch_or_stale(down, spark, path, "s", "2024-01-01", "2024-03-05", 5)


def test_html_says_where_it_is_cut(spark):
    df = spark.range(5)
    assert reports.html(df, "t", 3).count("<tr>") == 4 and "first 3 rows" in reports.html(df, "t", 3) and "first" not in reports.html(df, "t", 5)


def test_rows_used_are_those_of_the_window(spark):
    df = series(spark, [1.0, None, 3.0, 2.0]).withColumnRenamed("value", "vol").withColumns({"level": F.lit(1.0) * F.dayofmonth("date"), "fundamental": F.lit(2.0) * F.dayofmonth("date"), "sigma": F.lit(1.0)})
    h = signals.score_history(df, 3, 1).orderBy("date").collect()
    assert [r.n_obs_used for r in h] == [1, 3, 3] and [r.p_vol for r in h] == pytest.approx([1, 1, 0.5])


def test_reports_and_gate(spark, tmp_path):
    assert "| series_id |" in markdown(series(spark, [1]).select("series_id"), "t")
    verdicts = lambda *rows: spark.createDataFrame(list(rows), "code string, status string")
    bad, fine = verdicts(("B2.LjungBox_z2", "FAIL")), verdicts(("A1.ADF", "FAIL"), ("B4.KS", "WARN"), ("B1.LjungBox_z", "PASS"))
    with pytest.raises(DiagnosticFailure):
        gated(after=lambda df: bad)(lambda df: df)(series(spark, [1]))
    assert gated(before=lambda df: fine, after=lambda df: fine)(lambda df: df)(series(spark, [1])).count() == 1
    with gate(fine) as bag:
        bag["after"] = fine
    for before, after in ((verdicts(("A1.joint", "FAIL")), fine), (fine, bad), (fine, None)):
        with pytest.raises(DiagnosticFailure), gate(before) as bag:
            if after is not None:
                bag["after"] = after
    assert "Blocking: B2.LjungBox_z2" in reports.diagnostics_report(bad) and "<h2>Verdict</h2>" in reports.diagnostics_report(fine, True)
    t = series(spark, [1, 2])
    texts = [reports.backtest_report(t, t, t, t, t, t), reports.risk_report(t, t, t, t), reports.regime_report_text(t, t, t), reports.overlay_report(t, t, t)]
    assert [x.count("## ") for x in texts] == [6, 4, 4, 3] and "look ahead" in texts[2]
    reports.write_csv(t, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert reports.plot_data(series(spark, range(50)), "date", ["value"]).count() == 50 and reports.plot_data(series(spark, range(50)), "date", ["value"], 10).count() == 10


def test_streaming_fold(spark, tmp_path):
    from riskweave.streaming.folds import stream_fold

    src = str(tmp_path / "in")
    whole = series(spark, [0.01, -0.02, 0.03, 0.01, -0.01, 0.02], column="ret")
    whole.where(F.col("date") < DAY + dt.timedelta(3)).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(whole.schema).parquet(src)
    q = stream_fold(stream, ["ret"], 1e-4, folds.ewma_step(0.94), "sigma double").writeStream.format("memory").queryName("vol").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    whole.where(F.col("date") >= DAY + dt.timedelta(3)).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert column(spark.table("vol"), "sigma") == pytest.approx(column(folds.ewma_vol(whole, first_var=1e-4), "sigma"))
