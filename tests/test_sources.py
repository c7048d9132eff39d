"""Sources, the cache's rendering, screens that raise, overlay inputs, the command line, event-time streams."""

import datetime as dt
import hashlib
import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskweave import __main__ as cli
from riskweave.operators import calendar as cal
from riskweave.operators import quality, risk
from riskweave.plans import catalogue
from riskweave.sources import cache
from riskweave.sources import series as src
from riskweave.streaming.folds import publication_window, session_levels, windowed_levels

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def level(spark, values, name="s", start=DAY):
    return spark.createDataFrame([(name, start + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, date date, value double")


# --- vendors -----------------------------------------------------------------------------------------------


def test_levels_from_a_vendor(spark):
    asked = []

    def fetch(name, start, end):
        asked.append((name, start, end))
        return level(spark, range(40), start=dt.date(2023, 12, 20)).select("date", "value").where((F.col("date") >= start) & (F.col("date") <= end))

    got = src.fetch_levels(["a", "late"], "2024-01-05", "2024-01-10", fetch, {"late": 7}, {"a", "late", "b"}, {"old"})
    assert asked == [("a", "2024-01-05", "2024-01-10"), ("late", "2023-12-29", "2024-01-10")]
    rows = {(r.series_id, r.date): r.value for r in got.collect()}
    # what is published seven days late is dated when it was known
    assert rows["a", dt.date(2024, 1, 5)] == 16 and rows["late", dt.date(2024, 1, 5)] == 9 and max(d for _, d in rows) == dt.date(2024, 1, 10)
    for bad in (["old"], ["unheard"], []):
        with pytest.raises(ValueError):
            src.fetch_levels(bad, "2024-01-05", "2024-01-10", fetch, universe={"a", "old"}, discontinued={"old"})


def test_prices_from_a_vendor(spark):
    ends = []

    def vendor(drop):
        def fetch(name, start, end):
            ends.append(end)
            prices, p = [], 100.0
            for i in range(520):
                p *= 1 - 0.0045 if drop and i % 21 == 20 else 1.0 + 0.0003 * math.sin(i)
                prices.append(p)
            prices[30:34] = [prices[30]] * 4
            return spark.createDataFrame([(dt.date(2022, 1, 1) + dt.timedelta(i), 1.0, float(v)) for i, v in enumerate(prices)], "Date date, Open double, Close double")

        return fetch

    got = src.fetch_prices(["X"], "2022-01-01", "2023-06-01", vendor(False), {"X"}).orderBy("date").collect()
    assert ends[-1] == "2023-06-02" and got[-1].date == dt.date(2023, 6, 1)
    assert [r.value is None for r in got[29:35]] == [False, False, True, True, True, False]
    with pytest.raises(PySparkException, match="unadjusted"):
        src.fetch_prices(["X"], "2022-01-01", "2023-06-01", vendor(True)).collect()
    with pytest.raises(ValueError):
        src.fetch_prices(["Y"], "2022-01-01", "2023-06-01", vendor(False), {"X"})


def test_files(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    m = src.read_monthly_csv(spark, file("m.csv", "Date,GZ_spread,EBP\n2020-01-01,1.5,0.2\n2020-02-01,bad,0.3\n")).orderBy("date").collect()
    assert m[0].publication_date == dt.date(2020, 3, 16) and m[1].gz_spread is None and m[1].ebp == 0.3
    with pytest.raises(PySparkException, match="twice"):
        src.read_monthly_csv(spark, file("d.csv", "date,gz_spread,ebp\n2020-01-01,1,1\n2020-01-01,1,2\n")).collect()
    with pytest.raises(ValueError, match="missing"):
        src.read_monthly_csv(spark, file("x.csv", "date,ebp\n2020-01-01,1\n"))
    rates = file("r.csv", "date,default_rate,source,observation_date\n2019-12-01,2.0,b,2020-02-10\n2019-12-01,2.5,a,2020-02-10\n2019-12-01,9.0,a,2020-05-01\n")
    assert src.read_default_rates(spark, rates, "2020-02-01").count() == 0
    assert src.read_default_rates(spark, rates, "2020-02-15").first().default_rate == 2.5
    p = src.read_panel_csv(spark, file("p.csv", "date,sigma_ebp,sigma_oas,ebp_level,oas_level,default_proxy\n2020-01-01,1,2,3,4,x\n")).first()
    assert p.oas_level == 4 and p.default_proxy is None
    with pytest.raises(ValueError):
        src.read_panel_csv(spark, file("q.csv", "date,sigma_ebp\n2020-01-01,1\n"))
    level(spark, [1, 2, 3]).write.parquet(str(tmp_path / "s"))
    assert src.read_series(spark, str(tmp_path / "s"), ids=["s"], start="2024-01-02", end="2024-01-02").first().value == 2
    with pytest.raises(ValueError, match="unknown"):
        src.read_series(spark, str(tmp_path / "s"), ids=["t"], universe=["s"])
    with pytest.raises(ValueError, match="neither"):
        src.adjusted_close(level(spark, [1]).select("date"))


def test_wide_takes_the_least_of_values_on_a_date(spark):
    both = level(spark, [1, 2]).union(level(spark, [5, 6], "t")).union(level(spark, [0.5]))
    assert [(r.s, r.t) for r in src.wide(both, ["s", "t"]).orderBy("date").collect()] == [(0.5, 5.0), (2.0, 6.0)]
    assert [(r.s, r.t) for r in cal.align_union(both, ["s", "t"]).orderBy("date").collect()] == [(0.5, 5.0), (2.0, 6.0)]


def test_dates_are_normalised_and_may_not_repeat(spark):
    stamps = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 23, 30), 1.0), ("s", dt.datetime(2024, 1, 2, 1), 2.0)], "series_id string, date timestamp, value double")
    assert [r.date for r in cal.normalise_dates(stamps).orderBy("date").collect()] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    with pytest.raises(PySparkException, match="twice"):
        cal.normalise_dates(stamps, zone="Asia/Tokyo").collect()


# --- the cache ----------------------------------------------------------------------------------------------


def test_content_hash_is_of_the_csv_rendering(spark):
    values = [1.5, None, 1 / 3, 1e-7, 123456789.123456, 100.0]
    s = pd.Series([np.nan if v is None else v for v in values], index=pd.date_range("2024-01-01", periods=6))
    want = hashlib.sha256(s.to_csv(header=False, date_format="%Y-%m-%d", float_format="%.12g").encode()).hexdigest()
    assert cache.content_hash(level(spark, values)).first().content_hash == want


def test_covering_series(spark, tmp_path):
    tag = {"s": cache.fingerprint("level", "s", 1, "d")}
    meta = cache.write_cache(level(spark, [1, 2, 3]), str(tmp_path / "c"), tag)
    assert cache.covering(meta, tag, "2024-01-01", "2024-01-03").count() == 1
    assert cache.covering(meta, tag, "2024-01-01", "2024-01-04").count() == 0 and cache.covering(meta, {"s": "other"}, "2024-01-01", "2024-01-03").count() == 0


# --- screens and overlay ---------------------------------------------------------------------------------------


def test_stale_zeros_raise(spark):
    fine = level(spark, [1, 2, 2, 3, 4])
    assert quality.require_no_stale_zeros(fine, 2).count() == 5
    with pytest.raises(PySparkException, match="too long"):
        quality.require_no_stale_zeros(level(spark, [1, 2, 2, 2, 2, 3]), 2).collect()


def test_invalid_series_raise(spark):
    fine = level(spark, np.sin(np.arange(40)) + 5)
    assert quality.require_valid(fine, 30).count() == 40
    with pytest.raises(PySparkException, match="too short"):
        quality.require_valid(fine, 100).collect()


def overlay(spark, sigma, es, stressed, legacy=None):
    days = [DAY + dt.timedelta(i) for i in range(len(sigma))]
    a = spark.createDataFrame([("s", d, v) for d, v in zip(days, sigma)], "series_id string, date date, sigma_ann double")
    b = spark.createDataFrame([("s", d, v) for d, v in zip(days, es)], "series_id string, date date, es double")
    c = spark.createDataFrame([(d, v, True) for d, v in zip(days, stressed)], "date date, stressed boolean, confirms boolean")
    old = None if legacy is None else spark.createDataFrame(list(zip(days, legacy)), "date date, legacy boolean")
    return risk.overlay_inputs(a, b, c, old)


def test_overlay_inputs(spark):
    with pytest.warns(UserWarning, match="legacy"):
        assert [r.legacy for r in overlay(spark, [0.1, 0.2], [0.02, 0.02], [True, False]).collect()] == [False, False]
    for sigma, es, legacy, words in (([0.1, -0.2], [0.02, 0.02], [False] * 2, "positive"), ([0.1, None], [0.02, 0.02], [False] * 2, "missing"), ([0.1, float("nan")], [0.02, 0.02], [False] * 2, "missing"), ([0.1, 0.2], [0.02, 0.02], [False], "lacks a date")):
        with pytest.raises(PySparkException, match=words):
            overlay(spark, sigma, es, [True, False], legacy).collect()
    with pytest.raises(PySparkException, match="positive"):
        risk.annualised(spark.createDataFrame([(0.0,)], "s double"), "s").collect()
    flags = risk.stress_of_states(spark.createDataFrame([(i,) for i in (0, 1, 2, 3)], "state int")).collect()
    assert [r.legacy for r in flags] == [False, False, True, True]


def test_multiplier_of_a_date(spark):
    books = risk.books(risk.multipliers(overlay(spark, [0.2, 0.2, 0.05], [0.05, 0.01, 0.01], [False, True, False], [False] * 3)))
    day = DAY.isoformat()
    assert risk.multiplier_at(books, day).first().multiplier == pytest.approx(0.5)
    w = {r.asset: r.weight for r in risk.scaled_weights({"HYG": 0.6, "LQD": 0.4}, books, day).collect()}
    assert w == pytest.approx({"HYG": 0.3, "LQD": 0.2, "cash": 0.5})
    with pytest.raises(PySparkException, match="not in the overlay"):
        risk.multiplier_at(books, "2030-01-01").collect()
    for bad in ({"HYG": 0.5}, {"HYG": 0.5, "cash": 0.5}):
        with pytest.raises(ValueError):
            risk.scaled_weights(bad, books, day)


def test_detection_lags(spark):
    p = [0.1, 0.8, 0.9, 0.9, 0.2, 0.9, 0.9, 0.1]
    on = [False, False, False, True, True, False, False, True]
    df = spark.createDataFrame([("s", DAY + dt.timedelta(i), a, b) for i, (a, b) in enumerate(zip(p, on))], "series_id string, date date, p_stress double, stressed boolean")
    assert [r.lag for r in risk.detection_lags(df).orderBy("date").collect()] == [2, -1]


# --- look-ahead, command line, streams ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["dislocation_history", "anti_chattering_states", "gjr_filter_fixed", "pseudo_uniform_rank"])
def test_as_of_is_the_query_on_the_tables_of_that_day(spark, tmp_path, name):
    day = "1996-12-31"
    for t, c in src.KNOWN_AT.items():
        spark.read.parquet(f"{SF}/{t}.parquet").where(F.to_date(c) <= day).write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    with src.as_of(day):
        got = catalogue.QUERIES[name](spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got.agg(F.max("date")).first()[0] <= dt.date(1996, 12, 31)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(sys, "argv", ["riskweave", "equity_drawdown", "--data", SF, "--asof", "1995-06-30", "--out", str(tmp_path / "o")])
    cli.main()
    assert spark.read.parquet(str(tmp_path / "o")).agg(F.max("date")).first()[0] <= dt.date(1995, 6, 30)
    monkeypatch.setattr(sys, "argv", ["riskweave", "--list"])
    cli.main()
    assert "dislocation_history" in capsys.readouterr().out.split()


def test_event_time_windows(spark, tmp_path):
    whole = level(spark, range(1, 22))
    whole.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
    q = session_levels(whole_stream := source().where("day(date) NOT BETWEEN 8 AND 12")).writeStream.format("memory").outputMode("complete").queryName("sessions").option("checkpointLocation", str(tmp_path / "sessions")).start()
    q.processAllAvailable()
    q.stop()
    assert whole_stream.isStreaming and [r.n for r in spark.table("sessions").orderBy("start").collect()] == [7, 9]
    published = publication_window(source(), 5)
    assert published.isStreaming and "available" in published.columns
    for name, weekly in (("weeks", windowed_levels(source())), ("late", windowed_levels(published, watermark=None, time="available")), ("sliding", windowed_levels(source(), "7 days", "1 day"))):
        q = weekly.writeStream.format("memory").outputMode("complete").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(name).orderBy("start").collect()
        times = 7 if name == "sliding" else 1
        assert sum(r.n for r in got) == 21 * times and sum(r.n * r.mean for r in got) == pytest.approx(times * sum(range(1, 22))) and got[-1]["last"] == 21
