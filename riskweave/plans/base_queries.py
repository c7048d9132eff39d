"""Queries on calendars, returns, quality, windows and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import diagnostics, folds, panels, quality, returns, risk, rolling, scans, stats
from ..sources import series as src
from . import sql_parts as parts
from .registry import HOUR, LVL, MON, RET, SEG, SHIP, SRET, VIX, WEEK, query, r6, rounded, sql


def order_returns(spark, d):
    return returns.scaled_log_returns(src.orders_levels(spark, d)).withColumn("ret", rounded("ret", 8))


def segment_returns(spark, d):
    return returns.scaled_log_returns(src.segment_levels(spark, d)).withColumn("ret", rounded("ret", 8))


@query("coverage_report", sql(SEG, f"""SELECT series_id, min(date) AS start, max(date) AS "end", count(*) AS n_raw, count(value) AS n_obs, count(*) - count(value) AS n_nan,
  {r6("100.0 * (count(*) - count(value)) / count(*)")} AS pct_nan, CAST(greatest(0, date_diff('day', DATE '1994-06-01', min(date))) AS INTEGER) AS history_gap_days FROM seg GROUP BY 1"""))  # fmt: skip
def coverage_report(spark, d):
    return quality.coverage(src.segment_levels(spark, d), "1994-06-01").withColumn("pct_nan", rounded("pct_nan"))


@query("validate_series_issues", sql(SEG,
    "c AS (SELECT *, value - lag(value) OVER w AS ch FROM seg WINDOW w AS (PARTITION BY series_id ORDER BY date))",
    "c2 AS (SELECT *, lead(ch) OVER (PARTITION BY series_id ORDER BY date) AS nx FROM c)",
    "m AS (SELECT series_id, median(ch) AS mid FROM c WHERE ch IS NOT NULL GROUP BY 1)",
    "s AS (SELECT c.series_id, 1.4826 * median(abs(ch - mid)) AS sigma FROM c JOIN m USING (series_id) WHERE ch IS NOT NULL GROUP BY 1)",
    "j AS (SELECT series_id, count(*) AS n_jumps FROM c2 JOIN s USING (series_id) WHERE nx IS NOT NULL AND abs(ch) > 3 * sigma AND abs(ch + nx) <= 0.2 * abs(ch) GROUP BY 1)",
    """SELECT seg.series_id, count(value) AS n_obs, coalesce(any_value(n_jumps), 0) AS n_jumps,
  concat_ws('; ', CASE WHEN count(DISTINCT date) < count(*) THEN 'duplicate dates' END, CASE WHEN count(value) < 500 THEN 'too short' END,
    CASE WHEN count(*) FILTER (WHERE value < 0) > 0 THEN 'negative values' END, CASE WHEN coalesce(any_value(n_jumps), 0) > 0 THEN 'reversing jumps' END) AS issues
  FROM seg LEFT JOIN j USING (series_id) GROUP BY 1"""))  # fmt: skip
def validate_series_issues(spark, d):
    return quality.validate(src.segment_levels(spark, d), 500, kappa=3.0)


@query("level_changes_observed", sql(SEG, f"SELECT series_id, date, {r6('value - lag(value) OVER (PARTITION BY series_id ORDER BY date)')} AS change FROM seg"))
def level_changes_observed(spark, d):
    return returns.changes(src.segment_levels(spark, d)).select("series_id", "date", rounded("change").alias("change"))


@query("credit_stress_return", sql(SEG, f"SELECT series_id, date, {r6('-100 * (ln(value) - lag(ln(value)) OVER (PARTITION BY series_id ORDER BY date))')} AS ret FROM seg"))
def credit_stress_return(spark, d):
    return returns.stress_returns(src.segment_levels(spark, d)).select("series_id", "date", rounded("ret").alias("ret"))


@query("monthly_level_stress_return", sql(LVL, "me AS (SELECT series_id, last_day(date) AS month_end, max_by(value, date) AS value FROM lvl GROUP BY 1, 2)",
    f"SELECT series_id, month_end AS date, {r6('-(value - lag(value) OVER (PARTITION BY series_id ORDER BY month_end))')} AS ret FROM me"))
def monthly_level_stress_return(spark, d):
    return returns.level_stress_returns(cal.month_end_levels(src.orders_levels(spark, d))).select("series_id", "date", rounded("ret").alias("ret"))


@query("simple_returns", sql(SHIP, f"SELECT date, {r6('value / lag(value) OVER (ORDER BY date) - 1')} AS ret FROM ship"))
def simple_returns(spark, d):
    return returns.simple_returns(src.ship_prices(spark, d)).select("date", rounded("ret").alias("ret"))


def _forward(h: int) -> str:
    f = f"(ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(ret) OVER {f} = {h} THEN {r6(f'exp(sum(ln(1 + ret)) OVER {f}) - 1')} END AS fwd_{h}"


@query("forward_compounded_returns_h5_h10", sql(LVL, RET, f"SELECT date, {_forward(5)}, {_forward(10)} FROM ret"))
def forward_compounded_returns(spark, d):
    both = returns.forward_returns(returns.forward_returns(order_returns(spark, d), 5), 10)
    return both.select("date", rounded("fwd_5").alias("fwd_5"), rounded("fwd_10").alias("fwd_10"))


@query("log_realized_variance_w5", sql(LVL, RET, f"SELECT date, CASE WHEN count(ret) OVER w = 5 THEN {r6('ln(sum(ret * ret) OVER w)')} END AS log_rv FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"))
def log_realized_variance(spark, d):
    return returns.log_realised_variance(order_returns(spark, d), 5).select("date", rounded("log_rv").alias("log_rv"))


@query("equity_drawdown", sql(LVL, RET, "e AS (SELECT date, sum(ln(1 + ret)) OVER (ORDER BY date) AS le FROM ret)", f"SELECT date, {r6('exp(le)')} AS equity, {r6('exp(le) / max(exp(le)) OVER (ORDER BY date) - 1')} AS drawdown FROM e"))
def equity_drawdown(spark, d):
    return returns.equity(order_returns(spark, d)).select("date", rounded("equity").alias("equity"), rounded("drawdown").alias("drawdown"))


@query("publication_lag_weekly", sql(WEEK, f"SELECT series_id, CAST(date + 5 AS DATE) AS date, {r6('value')} AS value FROM week"))
def publication_lag_weekly(spark, d):
    return cal.publication_lag(src.weekly_events(spark, d), 5).withColumn("value", rounded("value"))


@query("publication_calendar_monthly", sql(MON, "SELECT date, CAST(last_day(date) + 45 AS DATE) AS publication_date FROM mon"))
def publication_calendar_monthly(spark, d):
    return src.monthly_levels(spark, d).select("date", cal.publication_date().alias("publication_date"))


@query("available_asof", sql(MON, f"SELECT date, {r6('value')} AS value, CAST(last_day(date) + 45 AS DATE) AS publication_date FROM mon WHERE last_day(date) + 45 <= DATE '1997-06-15'"))
def available_asof(spark, d):
    return cal.available_asof(src.monthly_levels(spark, d), "1997-06-15").select("date", rounded("value").alias("value"), "publication_date")


@query("reestimation_dates", sql(LVL, "n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS before FROM lvl)",
    """SELECT date, CAST(before AS INTEGER) AS before FROM n WHERE before >= 100 AND date = CAST(date_trunc('month', date) AS DATE)
  + CASE isodow(date_trunc('month', date)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END"""))  # fmt: skip
def reestimation_dates(spark, d):
    return cal.reestimation_dates(src.orders_levels(spark, d), 100).select("date", "before")


def _pair(spark, d):
    s = src.segment_levels(spark, d)
    a = s.where("series_id = 'AUTOMOBILE'").select("date", F.col("value").alias("a"))
    return a.join(s.where("series_id = 'BUILDING'").select("date", F.col("value").alias("b")), "date")


PAIR = "pair AS (SELECT x.date, x.value AS a, y.value AS b FROM seg x JOIN seg y ON x.date = y.date AND x.series_id = 'AUTOMOBILE' AND y.series_id = 'BUILDING')"


@query("default_proxy_spread", sql(SEG, PAIR, f"SELECT date, {r6('a - b')} AS proxy FROM pair"))
def default_proxy_spread(spark, d):
    return _pair(spark, d).select("date", rounded(F.col("a") - F.col("b")).alias("proxy"))


@query("default_proxy_ratio", sql(SEG, PAIR, f"SELECT date, {r6('a / b')} AS proxy FROM pair WHERE b > 0"))
def default_proxy_ratio(spark, d):
    return _pair(spark, d).where("b > 0").select("date", rounded(F.col("a") / F.col("b")).alias("proxy"))


@query("log_indicators", sql(VIX, LVL, SHIP, f"SELECT v.date, {r6('ln(v.value)')} AS ln_vix, {r6('ln(l.value)')} AS ln_hy, {r6('s.value / 1000')} AS slope FROM vix v JOIN lvl l USING (date) JOIN ship s USING (date)"))
def log_indicators(spark, d):
    slope = src.ship_prices(spark, d).withColumn("value", F.col("value") / 1000)
    out = cal.log_indicators(src.ship_counts(spark, d), src.orders_levels(spark, d), slope)
    return out.select("date", *[rounded(c).alias(c) for c in ("ln_vix", "ln_hy", "slope")])


@query("portfolio_returns_route_a", sql(SEG, SRET, f"""SELECT date, {r6("sum(ret * CASE series_id WHEN 'AUTOMOBILE' THEN 0.5 WHEN 'BUILDING' THEN 0.3 ELSE 0.2 END)")} AS ret FROM sret
  WHERE series_id IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') GROUP BY 1 HAVING count(*) = 3"""))  # fmt: skip
def portfolio_returns_route_a(spark, d):
    out = returns.portfolio_returns(segment_returns(spark, d), {"AUTOMOBILE": 0.5, "BUILDING": 0.3, "MACHINERY": 0.2})
    return out.select("date", rounded("ret").alias("ret"))


@query("asof_weekly_to_daily", sql("day AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)", WEEK, "w AS (SELECT series_id, CAST(date + 3 AS DATE) AS date, value FROM week)",
    "grid AS (SELECT date, series_id FROM day, (SELECT DISTINCT series_id FROM week))",
    f"SELECT g.series_id, g.date, {r6('w.value')} AS weekly FROM grid g ASOF LEFT JOIN w ON g.series_id = w.series_id AND g.date >= w.date"))
def asof_weekly_to_daily(spark, d):
    ev = src.read_table(spark, d, "events")
    week = src.weekly_events(spark, d)
    days = ev.select(F.to_date("ts").alias("date")).distinct()
    grid = days.crossJoin(F.broadcast(week.select("series_id").distinct()))
    late = cal.publication_lag(week, 3).withColumnRenamed("value", "weekly")
    out = cal.asof_join(grid, late, ["weekly"], ["series_id"])
    return out.select("series_id", "date", rounded("weekly").alias("weekly"))


@query("asof_monthly_causal", sql(LVL, MON, "p AS (SELECT CAST(last_day(date) + 45 AS DATE) AS pub, date AS month, value FROM mon)",
    f"SELECT l.date, {r6('l.value')} AS value, p.month, {r6('p.value')} AS monthly FROM lvl l ASOF LEFT JOIN p ON l.date >= p.pub"))
def asof_monthly_causal(spark, d):
    m = src.monthly_levels(spark, d)
    known = m.select(cal.publication_date().alias("date"), F.col("date").alias("month"), F.col("value").alias("monthly"))
    out = cal.asof_join(src.orders_levels(spark, d).select("date", "value"), known, ["month", "monthly"])
    return out.select("date", rounded("value").alias("value"), "month", rounded("monthly").alias("monthly"))


@query("lag_sensitivity_corr", sql(LVL, MON, "l AS (SELECT unnest([15, 30, 45, 60, 90]) AS lag)", "p AS (SELECT lag, CAST(last_day(date) + lag AS DATE) AS pub, value FROM mon, l)",
    "j AS (SELECT l.lag, lvl.value AS a, p.value AS b FROM (lvl CROSS JOIN l) ASOF LEFT JOIN p ON l.lag = p.lag AND lvl.date >= p.pub)",
    f"SELECT CAST(lag AS INTEGER) AS lag, count(*) FILTER (WHERE b IS NOT NULL) AS n, {r6('corr(a, b)')} AS corr FROM j GROUP BY 1"))
def lag_sensitivity_corr(spark, d):
    from ..functions.windows import safe_corr

    out = cal.lag_sensitivity(src.orders_levels(spark, d), src.monthly_levels(spark, d), [15, 30, 45, 60, 90])
    return out.groupBy("lag").agg(F.count("asof_value").alias("n"), rounded(safe_corr(F.when(F.col("asof_value").isNotNull(), F.col("value")), F.col("asof_value"))).alias("corr"))


@query("calendar_intersection", sql(SEG, "SELECT date FROM seg GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM seg)"))
def calendar_intersection(spark, d):
    return cal.calendar_intersection(src.segment_levels(spark, d))


@query("calendar_union_ffill", sql(SEG, "p AS (SELECT date, max(value) FILTER (WHERE series_id = 'AUTOMOBILE') AS a, max(value) FILTER (WHERE series_id = 'BUILDING') AS b FROM seg GROUP BY 1)",
    "f AS (SELECT date, last_value(a IGNORE NULLS) OVER (ORDER BY date) AS a, last_value(b IGNORE NULLS) OVER (ORDER BY date) AS b FROM p)",
    f"SELECT date, {r6('a')} AS automobile, {r6('b')} AS building FROM f WHERE a IS NOT NULL AND b IS NOT NULL"))
def calendar_union_ffill(spark, d):
    out = cal.align_union(src.segment_levels(spark, d), ["AUTOMOBILE", "BUILDING"])
    return out.select("date", rounded("AUTOMOBILE").alias("automobile"), rounded("BUILDING").alias("building"))


@query("aggregation_weights_month", sql(LVL, f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days, {r6('avg(value)')} AS mean FROM lvl GROUP BY 1"))
def aggregation_weights_month(spark, d):
    w = cal.aggregation_weights(src.orders_levels(spark, d))
    return w.groupBy("month").agg(F.count("*").alias("days"), rounded(F.sum(F.col("weight") * F.col("value"))).alias("mean"))


@query("aggregation_error", sql(LVL, MON, "m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(value) AS rep FROM lvl GROUP BY 1)", f"SELECT 'orders' AS series_id, count(*) AS months, {r6('max(abs(rep - value))')} AS max_error FROM m JOIN mon ON mon.date = month"))
def aggregation_error(spark, d):
    return cal.aggregation_error(src.orders_levels(spark, d), src.monthly_levels(spark, d)).withColumn("max_error", rounded("max_error"))


@query("calendar_slice", sql(SEG, "SELECT series_id, count(*) AS n, min(date) AS first, max(date) AS last FROM seg WHERE date BETWEEN DATE '1995-01-15' AND DATE '1996-03-31' GROUP BY 1"))
def calendar_slice(spark, d):
    return cal.slice_dates(src.segment_levels(spark, d), "1995-01-15", "1996-03-31").groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("history_gap", sql(SEG, "SELECT series_id, CAST(date_diff('day', DATE '1990-01-01', min(date)) AS INTEGER) AS gap_days FROM seg GROUP BY 1"))
def history_gap(spark, d):
    return quality.history_gap(src.segment_levels(spark, d), "1990-01-01")


@query("normalised_dates", sql("h AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, min(ts) AS ts FROM events GROUP BY 1, 2)", "SELECT series_id, date, count(*) AS n FROM h GROUP BY 1, 2"))
def normalised_dates(spark, d):
    daily = src.read_table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("day")).agg(F.min("ts").alias("date")).drop("day")
    return cal.normalise_dates(daily).groupBy("series_id", "date").agg(F.count("*").alias("n"))


@query("stress_of_states", sql(LVL, "SELECT date, day(date) % 4 IN (2, 3) AS legacy FROM lvl"))
def stress_of_states(spark, d):
    return risk.stress_of_states(src.orders_levels(spark, d).withColumn("state", F.dayofmonth("date") % 4)).select("date", "legacy")


@query("month_membership", sql(LVL, MON, "low AS (SELECT * FROM mon WHERE month(date) % 2 = 1)", f"SELECT date, {r6('value')} AS value FROM lvl WHERE CAST(date_trunc('month', date) AS DATE) IN (SELECT date FROM low)"))
def month_membership(spark, d):
    low = src.monthly_levels(spark, d).where(F.month("date") % 2 == 1)
    return cal.common_months(src.orders_levels(spark, d), low)[0].select("date", rounded("value").alias("value"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EPISODES = [("first", "1995-03-01", "1995-09-30"), ("second", "1996-06-15", "1997-01-15"), ("third", "1998-02-01", "1998-12-31")]
EPS = "ep(episode, s, e) AS (VALUES ('first', DATE '1995-03-01', DATE '1995-09-30'), ('second', DATE '1996-06-15', DATE '1997-01-15'), ('third', DATE '1998-02-01', DATE '1998-12-31'))"


def episodes_frame(spark):
    return spark.createDataFrame(EPISODES, "episode string, start string, end string").select("episode", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


@query("episode_interval_stats", sql(LVL, EPS, f"SELECT episode, count(*) AS n, {r6('avg(value)')} AS mean, {r6('max(value)')} AS top FROM lvl JOIN ep ON date BETWEEN s AND e GROUP BY 1"))
def episode_interval_stats(spark, d):
    inside = cal.in_episodes(src.orders_levels(spark, d), episodes_frame(spark))
    return inside.groupBy("episode").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"), rounded(F.max("value")).alias("top"))


@query("interval_join_overlapping", sql(LVL, "iv AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 1 + CAST(o_custkey % 90 AS INTEGER) AS e FROM orders WHERE o_orderpriority = '1-URGENT')",
    f"SELECT o_orderkey, count(*) AS n, {r6('avg(value)')} AS mean, {r6('max(value)')} AS top FROM iv JOIN lvl ON date BETWEEN s AND e GROUP BY 1"))
def interval_join_overlapping(spark, d):
    """The price level over the weeks after each urgent order: as many overlapping intervals as there are such orders."""
    orders = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    day = F.to_date("o_orderdate")
    intervals = orders.select("o_orderkey", day.alias("start"), F.date_add(day, (1 + F.col("o_custkey") % 90).cast("int")).alias("end"))
    inside = cal.interval_join(src.orders_levels(spark, d), intervals)
    return inside.groupBy("o_orderkey").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"), rounded(F.max("value")).alias("top"))


@query("supplier_correlations", sql("sm AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(avg(l_extendedprice) + 3e-8, 4) AS value FROM lineitem GROUP BY 1, 2)",
    f"SELECT x.series_id AS a, y.series_id AS b, count(*) AS n, {r6('corr(x.value, y.value)')} AS corr FROM sm x JOIN sm y ON x.date = y.date AND x.series_id < y.series_id GROUP BY 1, 2 HAVING count(*) >= 24"))
def supplier_correlations(spark, d):
    """Correlations of all suppliers' monthly mean prices."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    monthly = lines.groupBy(F.col("l_suppkey").cast("string").alias("series_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(F.round(F.avg("l_extendedprice") + 3e-8, 4).alias("value"))
    out = panels.correlations(monthly, least=24)
    return out.select("a", "b", "n", rounded("corr").alias("corr"))


def _rank(col: str, w: int, least: int, part: str = "") -> str:
    f = f"({part} ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    held = f"list({col}) FILTER (WHERE {col} IS NOT NULL) OVER {f}"
    return f"CASE WHEN {col} IS NOT NULL AND count({col}) OVER {f} >= {least} THEN len(list_filter({held}, lambda y: y <= {col})) / CAST(count({col}) OVER {f} AS DOUBLE) END"


@query("rolling_percentile_rank_w250", sql(LVL, f"SELECT date, {r6(_rank('value', 250, 250))} AS rank FROM lvl"))
def rolling_percentile_rank(spark, d):
    return rolling.percentile_rank(src.orders_levels(spark, d), 250).select("date", rounded("rank").alias("rank"))


@query("exogenous_confirm", sql(VIX, f"SELECT date, coalesce({_rank('value', 252, 60)} >= 0.8 AND max(value) OVER w - min(value) OVER w >= 1e-15, false) AS confirms FROM vix WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"))
def exogenous_confirm(spark, d):
    return rolling.exogenous_confirm(src.ship_counts(spark, d), 252, 60, 0.8).select("date", "confirms")


@query("rolling_std_and_hits", sql(LVL, RET, f"""SELECT date, CASE WHEN count(ret) OVER w = 20 THEN {r6("stddev_samp(ret) OVER w")} END AS sigma,
  CASE WHEN count(ret) OVER w = 20 THEN CAST(sum(CASE WHEN ret < -0.01 THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS hits FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))  # fmt: skip
def rolling_std_and_hits(spark, d):
    r = order_returns(spark, d).withColumn("hit", (F.col("ret") < -0.01).cast("int"))
    out = rolling.rolling_sum(rolling.rolling_std(r, 20, "ret"), 20, "hit", "hits")
    return out.select("date", rounded("sigma").alias("sigma"), "hits")


@query("expanding_median", sql(LVL, f"SELECT date, {r6('quantile_cont(value, 0.5) OVER (ORDER BY date)')} AS median FROM lvl"))
def expanding_median(spark, d):
    return rolling.expanding_median(src.orders_levels(spark, d), "value").select("date", rounded("median").alias("median"))


VAR = f"""var AS (SELECT series_id, date, ret, CASE WHEN count(ret) OVER w = 250 THEN -quantile_cont(ret, 0.05) OVER w END AS hs,
  CASE WHEN count(ret) OVER w = 250 THEN -(avg(ret) OVER w + (-1.6448536269514729) * stddev_samp(ret) OVER w) END AS nv FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))"""


@query("var_historical_normal_w250", sql(LVL, RET, VAR, f"SELECT date, {r6('hs')} AS var_hs, {r6('nv')} AS var_normal FROM var"))
def var_historical_normal(spark, d):
    return rolling.historical_var(order_returns(spark, d), 250, 0.95).select("date", rounded("var_hs").alias("var_hs"), rounded("var_normal").alias("var_normal"))


RUNS = [
    "c AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY date) AS ch FROM hour)",
    "h AS (SELECT *, coalesce(ch = 0, false) AS hold FROM c)",
    "i AS (SELECT *, sum(CASE WHEN hold AND NOT coalesce(ph, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY date) AS isl FROM (SELECT *, lag(hold) OVER (PARTITION BY series_id ORDER BY date) AS ph FROM h))",
    "g AS (SELECT *, CASE WHEN hold THEN count(*) OVER (PARTITION BY series_id, isl, hold) ELSE 0 END AS run FROM i)",
]


@query("longest_zero_run", sql(HOUR, *RUNS, """SELECT series_id, max(run) AS longest, round(avg(CAST(hold AS INT)), 6) AS zero_share, count(*) AS n,
  CAST(CASE WHEN avg(CAST(hold AS INT)) >= 0.05 AND avg(CAST(hold AS INT)) < 1 THEN greatest(2, ceil(ln(count(*) * (1 - avg(CAST(hold AS INT)))) / ln(1 / avg(CAST(hold AS INT)))
    + 3 * sqrt(pi() * pi() / (6 * pow(ln(1 / avg(CAST(hold AS INT))), 2)) + 1.0 / 12))) ELSE 2 END AS BIGINT) AS bound FROM g WHERE ch IS NOT NULL GROUP BY 1"""))  # fmt: skip
def longest_zero_run(spark, d):
    out = quality.zero_run_bound(src.hourly_events(spark, d))
    return out.select("series_id", F.col("longest").cast("long").alias("longest"), rounded("zero_share").alias("zero_share"), "n", "bound")


@query("mask_stale_runs", sql(HOUR, *RUNS, "SELECT series_id, date, CASE WHEN NOT (hold AND run > 2) THEN value END AS value, hold AND run > 2 AS masked FROM g"))
def mask_stale_runs(spark, d):
    return quality.mask_stale(src.hourly_events(spark, d))


@query("coupon_drop_report", sql(SHIP, "r AS (SELECT series_id, date, value / lag(value) OVER (ORDER BY date) - 1 AS ret FROM ship)", "r2 AS (SELECT * FROM r WHERE ret IS NOT NULL)",
    "h AS (SELECT series_id, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM r2 WHERE ret BETWEEN -0.006 AND -0.003)",
    f"SELECT 'ship' AS series_id, {r6('(SELECT count(*) FROM r2) / 252.0')} AS years, count(*) AS n_candidates, count(*) FILTER (WHERE gap BETWEEN 15 AND 35) AS n_monthly, count(*) > 0 AND count(*) >= 8 * ((SELECT count(*) FROM r2) / 252.0) AND count(*) FILTER (WHERE gap BETWEEN 15 AND 35) >= count(*) - 2 AS flagged FROM h"))
def coupon_drop_report(spark, d):
    return quality.coupon_drops(src.ship_prices(spark, d)).withColumn("years", rounded("years"))


HYST = f"sc AS (SELECT series_id, date, {_rank('value', 60, 60)} AS score FROM lvl), hy AS (SELECT *, coalesce(last_value(CASE WHEN score > 0.6 THEN true WHEN score < 0.3 THEN false END IGNORE NULLS) OVER (ORDER BY date), false) AS active FROM sc)"


def _flags(spark, d):
    return folds.hysteresis(rolling.percentile_rank(src.orders_levels(spark, d), 60, name="score"), "score", 0.6, 0.3)


@query("hysteresis_flags", sql(LVL, HYST, f"SELECT date, {r6('score')} AS score, active FROM hy"))
def hysteresis_flags(spark, d):
    return _flags(spark, d).select("date", rounded("score").alias("score"), "active")


@query("independent_episodes", sql(LVL, HYST, "s AS (SELECT *, sum(CASE WHEN active AND NOT coalesce(pa, false) THEN 1 ELSE 0 END) OVER (ORDER BY date) AS e FROM (SELECT *, lag(active) OVER (ORDER BY date) AS pa FROM hy))",
    "r AS (SELECT e, min(date) AS b, max(date) AS f FROM s WHERE active GROUP BY 1)", "q AS (SELECT coalesce(date_diff('day', lag(f) OVER (ORDER BY b), b) >= 20, true) AS fresh FROM r)",
    "SELECT 'orders' AS series_id, count(*) FILTER (WHERE fresh) AS n_episodes, count(*) AS n_runs FROM q"))
def independent_episodes(spark, d):
    return rolling.independent_episodes(_flags(spark, d), 20)


@query("pseudo_uniform_rank", sql(SEG, SRET, f"SELECT series_id, date, {r6('(rank() OVER (PARTITION BY series_id ORDER BY ret) + (count(*) OVER (PARTITION BY series_id, ret) - 1) / 2.0) / (count(*) OVER (PARTITION BY series_id) + 1)')} AS u FROM sret"))
def pseudo_uniform_rank(spark, d):
    return rolling.pseudo_uniforms(segment_returns(spark, d)).select("series_id", "date", rounded("u").alias("u"))


@query("rolling_pc1_two_series", sql(SEG, PAIR, f"""SELECT date, CASE WHEN count(*) OVER w = 60 THEN {r6("((a - avg(a) OVER w) / stddev_samp(a) OVER w + sign(covar_samp(a, b) OVER w) * (b - avg(b) OVER w) / stddev_samp(b) OVER w) / sqrt(2.0)")} END AS pc1
  FROM pair WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""))  # fmt: skip
def rolling_pc1(spark, d):
    pair = _pair(spark, d).withColumn("series_id", F.lit("pair"))
    return rolling.first_component_of_two(pair, "a", "b", 60).select("date", rounded("pc1").alias("pc1"))


@query("rolling_pc1_panel")
def rolling_pc1_panel(spark, d):
    """First component of all five segments' changes, 60 rows a window."""
    wide = segment_returns(spark, d).groupBy("date").agg(*[F.max(F.when(F.col("series_id") == s, F.col("ret"))).alias(s) for s in SEGMENTS])
    out = rolling.first_component(wide.withColumn("series_id", F.lit("segments")), SEGMENTS, 60, 40)
    return out.select("date", rounded("pc1").alias("pc1"))


CUS = "cu AS (SELECT date, sum(ret * ret) OVER (ORDER BY date) / sum(ret * ret) OVER () - row_number() OVER (ORDER BY date) / CAST(count(*) OVER () AS DOUBLE) AS cusum, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS t FROM ret)"


@query("cusum_of_squares", sql(LVL, RET, CUS, f"SELECT date, {r6('cusum')} AS cusum FROM cu"))
def cusum_of_squares(spark, d):
    return rolling.cusum_of_squares(order_returns(spark, d)).select("date", rounded("cusum").alias("cusum"))


@query("icss_first_break", sql(LVL, RET, CUS, f"SELECT 'orders' AS series_id, {r6('max(sqrt(t / 2.0) * abs(cusum))')} AS stat, arg_max(date, abs(cusum)) AS last_date_before, max(sqrt(t / 2.0) * abs(cusum)) > 1.358 AS is_break FROM cu WHERE k < t"))
def icss_first_break(spark, d):
    return rolling.first_break(order_returns(spark, d)).withColumn("stat", rounded("stat"))


@query("icss_breaks", sql(SEG, SRET, *parts.breaks("br", "sret", "ret"), "nn AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM sret)", "SELECT nn.series_id, nn.date FROM br JOIN nn ON nn.series_id = br.series_id AND nn.i = br.loc + 1", recursive=True))
def icss_breaks(spark, d):
    return rolling.icss_breaks(segment_returns(spark, d))


def _checked_sql(parts_: list[str], rows: list[tuple[str, str, str]]) -> str:
    """Verdict rows from common table expressions: (code, a relation with series_id and stat, the status)."""
    return sql(*parts_, " UNION ALL ".join(f"SELECT series_id, '{code}' AS code, {r6('stat')} AS statistic, {status} AS status FROM {source}" for code, source, status in rows), recursive=True)


#: Critical values of chi-square at 5 % by degrees of freedom, and of Kolmogorov's law.
CHI2 = {2: 5.991464547107979, 3: 7.814727903251179, 5: 11.070497693516351, 10: 18.307038053275146, 20: 31.410432844230918}
KOLMOGOROV = 1.3580986393225505
_PRE = [
    SEG, SRET, *parts.arch("a5", "sret", "ret", 5), *parts.arch("a10", "sret", "ret", 10), *parts.box("b10", "sret", "ret", 10), *parts.box("b20", "sret", "ret", 20), *parts.breaks("br", "sret", "ret"),
    "r1 AS (SELECT series_id, corr(ret, p) AS stat FROM (SELECT series_id, ret, lag(ret) OVER (PARTITION BY series_id ORDER BY date) AS p FROM sret) WHERE p IS NOT NULL GROUP BY 1)",
    "jm AS (SELECT series_id, count(*) AS n, avg(x*x) AS m2, avg(x*x*x) AS m3, avg(x*x*x*x) AS m4 FROM (SELECT series_id, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM sret) GROUP BY 1)",
    "jb AS (SELECT series_id, n / 6.0 * (m3 * m3 / pow(m2, 3) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS stat FROM jm)",
    "cq AS (SELECT series_id, sum(ret * ret) OVER (PARTITION BY series_id ORDER BY date) / sum(ret * ret) OVER (PARTITION BY series_id) AS c, row_number() OVER (PARTITION BY series_id ORDER BY date) AS k, count(*) OVER (PARTITION BY series_id) AS t FROM sret)",
    "cu AS (SELECT series_id, max(sqrt(t / 2.0) * abs(c - k / CAST(t AS DOUBLE))) AS stat FROM cq WHERE k < t GROUP BY 1)",
    "ic AS (SELECT s.series_id, CAST(count(loc) AS DOUBLE) AS stat FROM (SELECT DISTINCT series_id FROM sret) s LEFT JOIN br USING (series_id) GROUP BY 1)",
]
_WARN_ABOVE = "CASE WHEN {} > {} THEN 'WARN' ELSE 'PASS' END"


@query("diagnostics_pre_checked", _checked_sql(_PRE, [
    ("A2.ARCH_LM_5", "a5", f"CASE WHEN stat > {CHI2[5]} THEN 'PASS' ELSE 'WARN' END"), ("A2.ARCH_LM_10", "a10", f"CASE WHEN stat > {CHI2[10]} THEN 'PASS' ELSE 'WARN' END"), ("A3.rho1", "r1", _WARN_ABOVE.format("abs(stat)", 0.15)),
    ("A3.LjungBox_10", "b10", _WARN_ABOVE.format("stat", CHI2[10])), ("A3.LjungBox_20", "b20", _WARN_ABOVE.format("stat", CHI2[20])), ("A4.JarqueBera", "jb", _WARN_ABOVE.format("stat", CHI2[2])),
    ("A5.CUSUM", "cu", _WARN_ABOVE.format("stat", KOLMOGOROV)), ("A5.ICSS", "ic", _WARN_ABOVE.format("stat", 0))]))
def diagnostics_pre_checked(spark, d):
    """The suite's rows that SQL can check: all but the unit-root tests."""
    rows = diagnostics.pre_estimation(segment_returns(spark, d)).where("NOT code LIKE 'A1%'")
    return rows.select("series_id", "code", rounded("statistic").alias("statistic"), "status")


@query("diagnostics_pre")
def diagnostics_pre(spark, d):
    return diagnostics.pre_estimation(segment_returns(spark, d))


ACF = "cx AS (SELECT series_id, date, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM sret), " + "lg AS (SELECT series_id, x, " + ", ".join(f"lag(x, {k}) OVER (PARTITION BY series_id ORDER BY date) AS x{k}" for k in range(1, 11)) + " FROM cx), " + "ac AS (SELECT series_id, count(*) AS n, " + ", ".join(f"sum(x * x{k}) / sum(x * x) AS r{k}" for k in range(1, 11)) + " FROM lg GROUP BY 1)"
_Q = "n * (n + 2) * (" + " + ".join(f"r{k} * r{k} / (n - {k})" for k in range(1, 11)) + ")"


@query("acf_ljung_box", sql(SEG, SRET, ACF, f"qq AS (SELECT series_id, r1, {_Q} AS q FROM ac)", f"SELECT series_id, {r6('r1')} AS rho1, {r6('q')} AS q, {r6('exp(-q/2) * (1 + q/2 + pow(q/2,2)/2 + pow(q/2,3)/6 + pow(q/2,4)/24)')} AS p_value FROM qq"))
def acf_ljung_box(spark, d):
    r = segment_returns(spark, d)
    rho = stats.autocorrelations(r, 1).select("series_id", rounded("rho").alias("rho1"))
    return stats.ljung_box(r, 10).join(rho, "series_id").select("series_id", "rho1", rounded("q").alias("q"), rounded("p_value").alias("p_value"))


@query("jarque_bera_moments", sql(SEG, SRET, "c AS (SELECT series_id, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM sret)",
    "m AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, avg(x*x) AS m2, avg(x*x*x) AS m3, avg(x*x*x*x) AS m4 FROM c GROUP BY 1)", "g AS (SELECT *, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM m)",
    f"SELECT series_id, CAST(n AS BIGINT) AS n, {r6('sqrt(n * (n - 1)) / (n - 2) * g1')} AS skew, {r6('(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3')} AS kurtosis, {r6('n / 6 * (g1 * g1 + g2 * g2 / 4)')} AS jb FROM g"))
def jarque_bera_moments(spark, d):
    return stats.moments(segment_returns(spark, d)).select("series_id", "n", *[rounded(c).alias(c) for c in ("skew", "kurtosis", "jb")])


_q = 4
_VRL = ", ".join(f"lag(x, {k}) OVER w AS x{k}" for k in range(1, _q))
_VRC = ", ".join(f"sum(x * x * x{k} * x{k}) AS c{k}" for k in range(1, _q))
_PHI = " + ".join(f"pow(2.0 * ({_q} - {k}) / {_q}, 2) * n * c{k} / (ss * ss)" for k in range(1, _q))


@query("variance_ratio_lm", sql(SEG, SRET, "c AS (SELECT series_id, date, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM sret)",
    f"l AS (SELECT series_id, x, {_VRL}, CASE WHEN count(x) OVER r = {_q} THEN sum(x) OVER r END AS roll FROM c WINDOW w AS (PARTITION BY series_id ORDER BY date), r AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {_q - 1} PRECEDING AND CURRENT ROW))",
    f"s AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, sum(x * x) AS ss, sum(roll * roll) AS sr, {_VRC} FROM l GROUP BY 1)",
    f"v AS (SELECT *, (sr / ({_q} * (n - {_q} + 1) * (1 - {_q} / n))) / (ss / (n - 1)) AS vr FROM s)",
    f"SELECT series_id, {r6('vr')} AS vr, {r6(f'(vr - 1) / sqrt(2.0 * {2 * _q - 1} * {_q - 1} / (3 * {_q}) / n)')} AS z_homo, {r6(f'(vr - 1) / sqrt(({_PHI}) / n)')} AS z_robust FROM v"))
def variance_ratio_lm(spark, d):
    return stats.variance_ratio(segment_returns(spark, d), _q).select("series_id", *[rounded(c).alias(c) for c in ("vr", "z_homo", "z_robust")])


@query("arch_lm_q1", sql(SEG, SRET, "y AS (SELECT series_id, ret * ret AS y, lag(ret * ret) OVER (PARTITION BY series_id ORDER BY date) AS x FROM sret)", f"SELECT series_id, count(*) AS n, {r6('count(*) * pow(corr(y, x), 2)')} AS lm FROM y WHERE x IS NOT NULL GROUP BY 1"))
def arch_lm_q1(spark, d):
    return stats.arch_lm_one(segment_returns(spark, d)).withColumn("lm", rounded("lm"))


@query("arch_lm_q5", sql(SEG, SRET, *parts.arch("lm", "sret", "ret", 5), f"SELECT series_id, {r6('stat')} AS lm FROM lm"))
def arch_lm_q5(spark, d):
    return stats.arch_lm(segment_returns(spark, d), 5).select("series_id", rounded("stat").alias("lm"))


@query("adf_kpss_joint")
def adf_kpss_joint(spark, d):
    return stats.adf_kpss(src.segment_levels(spark, d))


@query("kpss_statistic", sql(SEG, "ke AS (SELECT series_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n, value - avg(value) OVER (PARTITION BY series_id) AS e, sum(value - m) OVER w AS s FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM seg) WINDOW w AS (PARTITION BY series_id ORDER BY date))",
    "kl AS (SELECT series_id, any_value(n) AS n, least(CAST(ceil(12 * pow(any_value(n) / 100.0, 0.25)) AS BIGINT), any_value(n) - 1) AS lags, sum(e * e) / any_value(n) AS g0, sum(s * s) AS ss FROM ke GROUP BY 1)",
    "kc AS (SELECT a.series_id, b.i - a.i AS k, sum(a.e * b.e) AS c FROM ke a JOIN kl ON kl.series_id = a.series_id JOIN ke b ON b.series_id = a.series_id AND b.i > a.i AND b.i <= a.i + kl.lags GROUP BY 1, 2)",
    "kv AS (SELECT kl.series_id, any_value(ss) / pow(any_value(kl.n), 2) / (any_value(g0) + 2 * sum((1 - k / CAST(lags + 1 AS DOUBLE)) * c / kl.n)) AS stat FROM kl JOIN kc USING (series_id) GROUP BY 1)",
    f"SELECT series_id, {r6('stat')} AS stat, {r6('CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - 0.05 * (stat - 0.347) / 0.116 WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / 0.111 WHEN stat <= 0.739 THEN 0.025 - 0.015 * (stat - 0.574) / 0.165 ELSE 0.01 END')} AS p_value FROM kv"))
def kpss_statistic(spark, d):
    out = stats.adf_kpss(src.segment_levels(spark, d)).where("test = 'kpss'")
    return out.select("series_id", rounded("stat").alias("stat"), rounded("p_value").alias("p_value"))


# --- folds -------------------------------------------------------------------------------------------

NUM = "nr AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM sret)"


def _recursive(state: str, first: str, step: str) -> str:
    """A recursive expression for one state along each series of nr."""
    return f"f AS (SELECT series_id, date, i, ret, CAST({first} AS DOUBLE) AS {state} FROM nr WHERE i = 1 UNION ALL SELECT n.series_id, n.date, n.i, n.ret, {step} FROM f JOIN nr n ON n.series_id = f.series_id AND n.i = f.i + 1)"


@query("ewma_vol", sql(SEG, SRET, NUM, _recursive("v", "ret * ret", "0.94 * f.v + 0.06 * f.ret * f.ret"), f"SELECT series_id, date, {r6('sqrt(v)')} AS sigma FROM f", recursive=True))
def ewma_vol(spark, d):
    return folds.ewma_vol(segment_returns(spark, d)).select("series_id", "date", rounded("sigma").alias("sigma"))


@query("gjr_filter_fixed", sql(SEG, SRET, NUM, _recursive("v", "0.0001", "0.000002 + (0.05 + CASE WHEN f.ret < 0 THEN 0.1 ELSE 0 END) * f.ret * f.ret + 0.85 * f.v"), f"SELECT series_id, date, {r6('sqrt(v)')} AS sigma FROM f", recursive=True))
def gjr_filter_fixed(spark, d):
    return folds.gjr_filter(segment_returns(spark, d), 0.000002, 0.05, 0.1, 0.85, 0.0001).select("series_id", "date", rounded("sigma").alias("sigma"))


_ZS = "zs AS (SELECT series_id, date, ret, ret / sqrt(v) AS z FROM f)"
_FAIL_ABOVE = "CASE WHEN {} >= {} THEN 'FAIL' ELSE 'PASS' END"


@query("diagnostics_post_fixed", _checked_sql([SEG, SRET, NUM, _recursive("v", "0.0001", "0.000002 + (0.05 + CASE WHEN f.ret < 0 THEN 0.1 ELSE 0 END) * f.ret * f.ret + 0.85 * f.v"), _ZS,
    *parts.box("b1", "zs", "z", 10), *parts.box("b2", "zs", "(z * z)", 10), *parts.arch("a5", "zs", "z", 5), *parts.arch("a10", "zs", "z", 10), *parts.sign_bias("sb", "zs", "z", "ret")],
    [("B1.LjungBox_z", "b1", _FAIL_ABOVE.format("stat", CHI2[10])), ("B2.LjungBox_z2", "b2", _FAIL_ABOVE.format("stat", CHI2[10])), ("B2.ARCH_LM_5", "a5", _FAIL_ABOVE.format("stat", CHI2[5])), ("B2.ARCH_LM_10", "a10", _FAIL_ABOVE.format("stat", CHI2[10])),
     ("B2.ARCH_LM", "a10", _FAIL_ABOVE.format("stat", CHI2[10])), ("B3.EngleNg", "sb", f"CASE WHEN stat > {CHI2[3]} THEN 'FAIL' ELSE 'PASS' END")]))
def diagnostics_post_fixed(spark, d):
    """The residual tests of a filter with fixed parameters."""
    s = folds.gjr_filter(segment_returns(spark, d), 0.000002, 0.05, 0.1, 0.85, 0.0001).withColumn("z", F.col("ret") / F.col("sigma"))
    return diagnostics.residual_checks(s, "gjr", eps="ret").select("series_id", "code", rounded("statistic").alias("statistic"), "status")


@query("standardised_residuals", sql(SEG, SRET, NUM, _recursive("v", "ret * ret", "0.94 * f.v + 0.06 * f.ret * f.ret"), "zz AS (SELECT series_id, date, ret / sqrt(v) AS z FROM f WHERE v > 0)", f"SELECT series_id, date, {r6('z / stddev_samp(z) OVER (PARTITION BY series_id)')} AS z FROM zz", recursive=True))
def standardised_residuals(spark, d):
    s = folds.ewma_vol(segment_returns(spark, d)).where("sigma > 0").withColumnRenamed("ret", "eps")
    return returns.standardised_residuals(s).select("series_id", "date", rounded("z").alias("z"))


@query("egarch_filter_fixed", sql(SEG, SRET, NUM, _recursive("v", "-9.0", "-0.9 + 0.15 * (abs(f.ret / exp(f.v / 2)) - 0.7978845608028654) - 0.1 * f.ret / exp(f.v / 2) + 0.9 * f.v"), f"SELECT series_id, date, {r6('exp(v / 2)')} AS sigma FROM f", recursive=True))
def egarch_filter_fixed(spark, d):
    return folds.egarch_filter(segment_returns(spark, d), -0.9, 0.15, -0.1, 0.9, -9.0).select("series_id", "date", rounded("sigma").alias("sigma"))


@query("arma_residuals_fixed", sql(SEG, SRET, NUM, _recursive("e", "ret - 0.0001", "n.ret - 0.0001 - 0.2 * f.ret + 0.5 * f.e"), f"SELECT series_id, date, {r6('e')} AS eps FROM f", recursive=True))
def arma_residuals_fixed(spark, d):
    return folds.arma_residuals(segment_returns(spark, d), 0.0001, 0.2, -0.5).select("series_id", "date", rounded("eps").alias("eps"))


_HP = "(0.95 * f.p + 0.03 * (1 - f.p))"


def _post(prior: str, x: str) -> str:
    hi, lo = f"exp(-0.5 * pow(({x} - 0.0) / 0.012, 2)) / 0.012", f"exp(-0.5 * pow(({x} - 0.0) / 0.004, 2)) / 0.004"
    return f"{prior} * {hi} / ({prior} * {hi} + (1 - {prior}) * {lo})"


_START = "(0.95 * (0.03 / 0.08) + 0.03 * (1 - 0.03 / 0.08))"


@query("hamilton_filter_fixed", sql(SEG, SRET, NUM, _recursive("p", _post(_START, "ret"), _post(_HP, "n.ret")), f"SELECT series_id, date, {r6('p')} AS p_stress FROM f", recursive=True))
def hamilton_filter_fixed(spark, d):
    return folds.hamilton_filter(segment_returns(spark, d), "ret", (0.97, 0.95), (0.0, 0.0), (0.004, 0.012)).select("series_id", "date", rounded("p_stress").alias("p_stress"))


_P3 = ((0.95, 0.04, 0.01), (0.05, 0.90, 0.05), (0.02, 0.08, 0.90))
_S3 = (0.003, 0.006, 0.014)


def _three(prior: list[str], x: str) -> list[str]:
    like = [f"exp(-0.5 * pow({x} / {s}, 2)) / {s}" for s in _S3]
    total = " + ".join(f"({p}) * {v}" for p, v in zip(prior, like))
    return [f"({p}) * {v} / ({total})" for p, v in zip(prior, like)]


def _three_sql() -> str:
    first = [" + ".join(f"{0.3333333333333333} * {_P3[i][j]}" for i in range(3)) for j in range(3)]
    later = [" + ".join(f"f.p{i} * {_P3[i][j]}" for i in range(3)) for j in range(3)]
    a, b = _three(first, "ret"), _three(later, "n.ret")
    pick = lambda x: ", ".join(f"CAST({v} AS DOUBLE) AS p{k}" for k, v in enumerate(x))
    f = f"f AS (SELECT series_id, date, i, ret, {pick(a)} FROM nr WHERE i = 1 UNION ALL SELECT n.series_id, n.date, n.i, n.ret, {pick(b)} FROM f JOIN nr n ON n.series_id = f.series_id AND n.i = f.i + 1)"
    return sql(SEG, SRET, NUM, f, f"SELECT series_id, date, {r6('p0')} AS calm, {r6('p1')} AS mid, {r6('p2')} AS stress FROM f", recursive=True)


def _smooth_sql() -> str:
    first = [" + ".join(f"{0.3333333333333333} * {_P3[i][j]}" for i in range(3)) for j in range(3)]
    later = [" + ".join(f"f.p{i} * {_P3[i][j]}" for i in range(3)) for j in range(3)]
    pick = lambda x, c: ", ".join(f"CAST({v} AS DOUBLE) AS {c}{k}" for k, v in enumerate(x))
    f = f"f AS (SELECT series_id, date, i, ret, {pick(_three(first, 'ret'), 'p')} FROM nr WHERE i = 1 UNION ALL SELECT n.series_id, n.date, n.i, n.ret, {pick(_three(later, 'n.ret'), 'p')} FROM f JOIN nr n ON n.series_id = f.series_id AND n.i = f.i + 1)"
    prior = [" + ".join(f"p.p{i} * {_P3[i][j]}" for i in range(3)) for j in range(3)]
    smooth = [f"p.p{i} * (" + " + ".join(f"{_P3[i][j]} * s.s{j} / ({prior[j]})" for j in range(3)) + ")" for i in range(3)]
    s = f"s AS (SELECT series_id, date, i, {pick(['p0', 'p1', 'p2'], 's')} FROM f WHERE i = (SELECT max(i) FROM nr WHERE nr.series_id = f.series_id) UNION ALL SELECT p.series_id, p.date, p.i, {pick(smooth, 's')} FROM s JOIN f p ON p.series_id = s.series_id AND p.i = s.i - 1)"
    return sql(SEG, SRET, NUM, f, s, f"SELECT series_id, date, {r6('s0')} AS calm, {r6('s1')} AS mid, {r6('s2')} AS stress FROM s", recursive=True)


@query("kim_smoother", _smooth_sql())
def kim_smoother(spark, d):
    out = scans.kim_smoother(segment_returns(spark, d), "ret", _P3, (0.0, 0.0, 0.0), _S3, ("calm", "mid", "stress"))
    return out.select("series_id", "date", *[rounded(c).alias(c) for c in ("calm", "mid", "stress")])


@query("hamilton_three_states", _three_sql())
def hamilton_three_states(spark, d):
    out = folds.hamilton_states(segment_returns(spark, d), "ret", _P3, (0.0, 0.0, 0.0), _S3, ("calm", "mid", "stress"))
    return out.select("series_id", "date", *[rounded(c).alias(c) for c in ("calm", "mid", "stress")])
