"""Queries on signals, costs, VaR backtests, regimes and the overlay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.windows import over, safe_corr
from ..operators import calendar as cal
from ..operators import folds, returns, risk, rolling, signals, stats
from ..sources import series as src
from .base_queries import EPS, HYST, PAIR, VAR, _flags, _rank, episodes_frame, order_returns, segment_returns
from . import sql_parts as parts
from .registry import LVL, RET, SEG, SHIP, SRET, query, r6, rounded, sql


# --- VaR backtests -----------------------------------------------------------------------------------

P = 0.05
HIT = "hit AS (SELECT series_id, date, ret, hs AS var, CASE WHEN ret < -hs THEN 1 ELSE 0 END AS hit FROM var WHERE hs IS NOT NULL)"
_XL = "CASE WHEN {0} > 0 THEN {0} * ln({1}) ELSE 0 END"


def _hits(spark, d):
    v = rolling.historical_var(order_returns(spark, d), 250, 1 - P).withColumn("var", F.col("var_hs"))
    return risk.hits(v)


@query("hit_series", sql(LVL, RET, VAR, HIT, f"SELECT date, {r6('var')} AS var, hit FROM hit"))
def hit_series(spark, d):
    return _hits(spark, d).select("date", rounded("var").alias("var"), "hit")


def _uc(n: str, x: str) -> str:
    free = f"({_XL.format(f'({n} - {x})', f'(1 - {x} / {n})')} + {_XL.format(x, f'({x} / {n})')})"
    return f"(-2 * (({n} - {x}) * ln(1 - {P}) + {x} * ln({P}) - {free}))"


KUP = f"ku AS (SELECT *, CASE WHEN abs(lr) < 1e-12 THEN 0 ELSE lr END AS lr_uc FROM (SELECT *, {_uc('nn', 'x')} AS lr FROM (SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS nn, CAST(sum(hit) AS DOUBLE) AS x FROM hit)))"


@query("kupiec_pof", sql(LVL, RET, VAR, HIT, KUP, f"SELECT n, CAST(x AS BIGINT) AS x, {r6('x / nn')} AS hit_rate, {r6('lr_uc')} AS lr_uc FROM ku"))
def kupiec_pof(spark, d):
    return risk.kupiec(_hits(spark, d), P).select("n", "x", rounded("hit_rate").alias("hit_rate"), rounded("lr_uc").alias("lr_uc"))


TRANS = "tr AS (SELECT CAST(count(*) FILTER (WHERE p = 0 AND hit = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (WHERE p = 0 AND hit = 1) AS DOUBLE) AS n01, CAST(count(*) FILTER (WHERE p = 1 AND hit = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (WHERE p = 1 AND hit = 1) AS DOUBLE) AS n11 FROM (SELECT hit, lag(hit) OVER (ORDER BY date) AS p FROM hit))"
_PI = "((n01 + n11) / (n00 + n01 + n10 + n11))"
_IND = f"CASE WHEN n00 + n01 = 0 OR n10 + n11 = 0 THEN 0 ELSE -2 * ({_XL.format('(n00 + n10)', f'(1 - {_PI})')} + {_XL.format('(n01 + n11)', _PI)} - ({_XL.format('n00', '(n00 / (n00 + n01))')} + {_XL.format('n01', '(n01 / (n00 + n01))')} + {_XL.format('n10', '(n10 / (n10 + n11))')} + {_XL.format('n11', '(n11 / (n10 + n11))')})) END"


@query("christoffersen_ind_cc", sql(LVL, RET, VAR, HIT, KUP, TRANS, f"i AS (SELECT *, {_IND} AS lr_ind FROM tr)",
    f"SELECT CAST(n00 AS BIGINT) AS n00, CAST(n01 AS BIGINT) AS n01, CAST(n10 AS BIGINT) AS n10, CAST(n11 AS BIGINT) AS n11, {r6('lr_ind')} AS lr_ind, {r6('lr_uc + lr_ind')} AS lr_cc, {r6('exp(-(lr_uc + lr_ind) / 2)')} AS p_cc FROM i, ku"))
def christoffersen_ind_cc(spark, d):
    out = risk.conditional_coverage(_hits(spark, d), P)
    return out.select("n00", "n01", "n10", "n11", *[rounded(c).alias(c) for c in ("lr_ind", "lr_cc", "p_cc")])


@query("basel_zone", sql(LVL, RET, VAR, HIT, "l AS (SELECT sum(hit) AS x FROM (SELECT hit FROM hit ORDER BY date DESC LIMIT 250))", "SELECT CAST(x AS BIGINT) AS exceptions, CASE WHEN x <= 4 THEN 'green' WHEN x <= 9 THEN 'yellow' ELSE 'red' END AS zone FROM l"))
def basel_zone(spark, d):
    newest = _hits(spark, d).orderBy(F.desc("date")).limit(250)
    return newest.agg(F.sum("hit").cast("long").alias("exceptions")).select("exceptions", risk.basel_zone(F.col("exceptions")).alias("zone"))


@query("acerbi_z1_z2", sql(LVL, RET, VAR, HIT, f"SELECT {r6('avg(ret / (1.3 * var)) FILTER (WHERE hit = 1) + 1')} AS z1, {r6(f'sum(ret * hit / (1.3 * var)) / (count(*) * {P}) + 1')} AS z2 FROM hit"))
def acerbi_z1_z2(spark, d):
    out = risk.acerbi(_hits(spark, d).withColumn("es", 1.3 * F.col("var")), P)
    return out.select(rounded("z1").alias("z1"), rounded("z2").alias("z2"))


def _models(spark, d):
    v = rolling.historical_var(order_returns(spark, d), 250, 1 - P)
    rows = [v.select(F.lit(m).alias("model"), "date", "ret", F.col(c).alias("var"), (1.25 * F.col(c)).alias("es")) for m, c in (("hs", "var_hs"), ("normal", "var_normal"))]
    return rows[0].unionByName(rows[1])


@query("backtest_suite_comparison", sql(LVL, RET, VAR, "m AS (SELECT 'hs' AS model, date, ret, hs AS var FROM var WHERE hs IS NOT NULL UNION ALL SELECT 'normal', date, ret, nv FROM var WHERE nv IS NOT NULL)",
    "b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM m)",
    "w AS (SELECT model, 'full' AS win, ret, var FROM b UNION ALL SELECT model, 'rolling', ret, var FROM b WHERE k <= 250)",
    f'SELECT model, win AS "window", count(*) AS n, CAST(count(*) FILTER (WHERE ret < -var) AS BIGINT) AS x, {r6("count(*) FILTER (WHERE ret < -var) / CAST(count(*) AS DOUBLE)")} AS hit_rate, {r6("avg(ret / (1.25 * var)) FILTER (WHERE ret < -var) + 1")} AS z1 FROM w GROUP BY 1, 2'))
def backtest_suite_comparison(spark, d):
    return risk.backtest_suite(_models(spark, d), P).select("model", "window", "n", "x", rounded("hit_rate").alias("hit_rate"), rounded("z1").alias("z1"))


_SUITE = [
    "m AS (SELECT 'hs' AS model, date, ret, hs AS var FROM var WHERE hs IS NOT NULL UNION ALL SELECT 'normal', date, ret, nv FROM var WHERE nv IS NOT NULL)",
    "b AS (SELECT *, CASE WHEN ret < -var THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY model ORDER BY date DESC) AS k FROM m)",
    "w AS (SELECT model, 'full' AS win, date, ret, var, hit FROM b UNION ALL SELECT model, 'rolling', date, ret, var, hit FROM b WHERE k <= 250)",
    "wl AS (SELECT *, lag(hit) OVER (PARTITION BY model, win ORDER BY date) AS p FROM w)",
    "wc AS (SELECT model, win, CAST(count(*) AS DOUBLE) AS nn, CAST(sum(hit) AS DOUBLE) AS x, CAST(count(*) FILTER (WHERE p = 0 AND hit = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (WHERE p = 0 AND hit = 1) AS DOUBLE) AS n01, CAST(count(*) FILTER (WHERE p = 1 AND hit = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (WHERE p = 1 AND hit = 1) AS DOUBLE) AS n11, avg(ret / (1.25 * var)) FILTER (WHERE hit = 1) + 1 AS z1, sum(ret * hit / (1.25 * var)) / (count(*) * 0.05) + 1 AS z2 FROM wl GROUP BY 1, 2)",
    f"wt AS (SELECT *, {_uc('nn', 'x')} AS uc, {_IND} AS ind, CASE WHEN x <= 4 THEN 'green' WHEN x <= 9 THEN 'yellow' ELSE 'red' END AS basel FROM wc)",
    "wv AS (SELECT *, CASE WHEN uc > 3.841458820694124 OR exp(-(uc + ind) / 2) < 0.05 OR basel = 'red' THEN 2 WHEN basel = 'yellow' THEN 1 ELSE 0 END AS v FROM wt)",
]
_VERDICT = "CASE {} WHEN 2 THEN 'reject' WHEN 1 THEN 'scrutiny' ELSE 'pass' END"


@query("backtest_suite_verdicts", sql(LVL, RET, VAR, *_SUITE, f"SELECT model, win AS \"window\", {r6('uc')} AS lr_uc, {r6('uc + ind')} AS lr_cc, {r6('z1')} AS z1, {r6('z2')} AS z2, basel, {_VERDICT.format('v')} AS verdict, {_VERDICT.format('max(v) OVER ()')} AS worst_verdict FROM wv"))
def backtest_suite_verdicts(spark, d):
    out = risk.backtest_suite(_models(spark, d), P)
    return out.select("model", "window", *[rounded(c).alias(c) for c in ("lr_uc", "lr_cc", "z1", "z2")], "basel", "verdict", "worst_verdict")


@query("dynamic_quantile", sql(LVL, RET, VAR, HIT, f"dl AS (SELECT series_id, hit - {P} AS h, 1.0 AS one, var, {', '.join(f'lag(hit - {P}, {k}) OVER (ORDER BY date) AS h{k}' for k in range(1, 5))} FROM hit)",
    *parts.regression("dr", "dl", "h", ["one", "var", "h1", "h2", "h3", "h4"]), "dq AS (SELECT series_id, (total - sse) / (sse / (n - k)) AS dq, k FROM dr)",
    f"SELECT series_id, {r6('dq')} AS dq, {r6('exp(-dq / 2) * (1 + dq / 2 + dq * dq / 8)')} AS p_value, CAST(k AS INTEGER) AS df FROM dq"))
def dynamic_quantile(spark, d):
    return risk.dynamic_quantile(_hits(spark, d), P).select("series_id", rounded("dq").alias("dq"), rounded("p_value").alias("p_value"), "df")


@query("acerbi_null")
def acerbi_null(spark, d):
    return risk.acerbi_null(250, P, 10_000, 7, spark).agg(F.avg("z1").alias("z1"), F.avg("z2").alias("z2"), F.count("*").alias("n"))


# --- signal, costs, performance -------------------------------------------------------------------------


#: The two segments whose ratio stands for the fundamental spread.
PAIRED = {"a": "AUTOMOBILE", "b": "BUILDING"}


def dislocation_panel(spark, d, vol_window: int = 20):
    """The flagship's inputs on one calendar: price volatility, level, fundamental spread, level volatility; and the
    level's return on its own days. Orders are read once, and what is a window of their daily level is one."""
    price = rolling.rolling_std(returns.simple_returns(src.ship_prices(spark, d)), vol_window, "ret", "vol").select("date", "vol")
    days = rolling.rolling_std(returns.stress_returns(src.order_days(spark, d, PAIRED)), vol_window, "ret", "sigma")
    scaled = rounded(0.01 * F.ln(F.col("value") / F.lag("value").over(over())), 8)
    days = days.select("date", F.col("value").alias("level"), "sigma", (F.col("a") / F.col("b")).alias("fundamental"), scaled.alias("ret"))
    dates = price.join(days, "date", "full").withColumn("series_id", F.lit("orders"))
    return cal.union_fill(dates, ["vol", "level", "fundamental", "sigma"], keep=("ret",))


PANEL = ", ".join([
    "pr AS (SELECT date, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS vol FROM (SELECT date, value / lag(value) OVER (ORDER BY date) - 1 AS r FROM ship) WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
    "st AS (SELECT date, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS sigma FROM (SELECT date, -100 * (ln(value) - lag(ln(value)) OVER (ORDER BY date)) AS r FROM lvl) WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
    "un AS (SELECT date, vol, lvl.value AS level, sigma, a / b AS fundamental FROM pr FULL JOIN lvl USING (date) FULL JOIN st USING (date) FULL JOIN pair USING (date))",
    "fl AS (SELECT date, last_value(vol IGNORE NULLS) OVER w AS vol, last_value(level IGNORE NULLS) OVER w AS level, last_value(fundamental IGNORE NULLS) OVER w AS fundamental, last_value(sigma IGNORE NULLS) OVER w AS sigma FROM un WINDOW w AS (ORDER BY date))",
    "pn AS (SELECT * FROM fl WHERE vol IS NOT NULL AND level IS NOT NULL AND fundamental IS NOT NULL AND sigma IS NOT NULL)",
    f"rk AS (SELECT *, {_rank('vol', 250, 250)} AS p_vol, {_rank('level', 250, 250)} AS p_level, {_rank('fundamental', 250, 250)} AS p_fund FROM pn)",
    "sc2 AS (SELECT *, greatest(-1.0, least(1.0, (0.5 * p_vol + 0.5 * p_level) * (1 - p_fund) - (1 - (0.5 * p_vol + 0.5 * p_level)) * p_fund)) AS score FROM rk WHERE p_vol IS NOT NULL AND p_level IS NOT NULL AND p_fund IS NOT NULL)",
    "dh AS (SELECT *, coalesce(last_value(CASE WHEN round(score, 9) > 0.6 THEN true WHEN round(score, 9) < 0.3 THEN false END IGNORE NULLS) OVER (ORDER BY date), false) AS active, greatest(-1.0, least(1.0, 0.1 * score / sigma)) AS weight FROM sc2)",
])


def _rounded_score(v, lv, f):
    return F.round(signals.bilinear_score()(v, lv, f), 9)


def _history(spark, d, window: int = 250):
    return signals.score_history(dislocation_panel(spark, d), window, scoring=_rounded_score)


@query("dislocation_history", sql(LVL, SEG, SHIP, PAIR, PANEL, f"SELECT date, {r6('p_vol')} AS p_vol, {r6('p_level')} AS p_level, {r6('p_fund')} AS p_fund, {r6('score')} AS score, active, {r6('weight')} AS weight FROM dh"))
def dislocation_history(spark, d):
    h = _history(spark, d)
    return h.select("date", *[rounded(c).alias(c) for c in ("p_vol", "p_level", "p_fund", "score")], "active", rounded("weight").alias("weight"))


@query("explain_latest", sql(LVL, SEG, SHIP, PAIR, PANEL, f"SELECT date, {r6('score')} AS score, active, {r6('weight')} AS weight FROM dh WHERE date <= DATE '1997-06-30' ORDER BY date DESC LIMIT 1"))
def explain_latest(spark, d):
    return signals.explain(_history(spark, d), "1997-06-30").select("date", rounded("score").alias("score"), "active", rounded("weight").alias("weight"))


STRAT_IN = "si AS (SELECT dh.date, weight, sigma, ret FROM dh JOIN ret USING (date))"
STRAT = "sr AS (SELECT date, ret, weight, held, (3.0 + 1.5 * sigma / med) / 1e4 * abs(weight - held) AS cost FROM (SELECT *, coalesce(lag(weight) OVER (ORDER BY date), 0.0) AS held, quantile_cont(sigma, 0.5) OVER (ORDER BY date) AS med FROM si))"


def _strategy_inputs(spark, d):
    return _history(spark, d).where("ret IS NOT NULL")


@query("strategy_returns_costs", sql(LVL, SEG, SHIP, PAIR, PANEL, RET, STRAT_IN, STRAT, f"SELECT date, {r6('held')} AS held, {r6('1e4 * cost')} AS cost_bps, {r6('held * ret - cost')} AS strat_ret FROM sr"))
def strategy_returns_costs(spark, d):
    out = signals.priced_returns(_strategy_inputs(spark, d))
    return out.select("date", rounded("held").alias("held"), rounded(1e4 * F.col("cost")).alias("cost_bps"), rounded("strat_ret").alias("strat_ret"))


@query("explain_decomposition", sql(LVL, SEG, SHIP, PAIR, PANEL, "no AS (SELECT date, least(250, row_number() OVER (ORDER BY date)) AS n_obs FROM pn)", "ex AS (SELECT * FROM dh JOIN no USING (date))",
    f"SELECT date, {r6('score')} AS score, {r6('0.5 * p_vol + 0.5 * p_level')} AS stress, {r6('p_fund')} AS p_fund, {r6('vol')} AS vol, {r6('sigma')} AS sigma, {r6('level')} AS level, {r6('fundamental')} AS fundamental, 'ratio' AS proxy, active, {r6('weight')} AS weight, 250 AS \"window\", CAST(n_obs AS BIGINT) AS n_obs_used FROM ex WHERE date <= DATE '1997-06-30' ORDER BY date DESC LIMIT 1"))
def explain_decomposition(spark, d):
    out = signals.decomposition(_history(spark, d), "1997-06-30", 250, "ratio")
    figures = [rounded(c).alias(c) for c in ("score", "stress", "p_fund", "vol", "sigma", "level", "fundamental", "weight")]
    return out.select("date", *figures, "proxy", "active", "window", F.col("n_obs_used").cast("long").alias("n_obs_used"))


@query("cost_sensitivity", sql(LVL, SEG, SHIP, PAIR, PANEL, RET, STRAT_IN, STRAT, f"SELECT multiplier, {r6('sum(m * cost)')} AS total_cost, {r6('sum(held * ret - m * cost)')} AS total_return FROM sr, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE]) AS multiplier), LATERAL (SELECT multiplier AS m) GROUP BY 1"))
def cost_sensitivity(spark, d):
    out = signals.cost_sensitivity(_strategy_inputs(spark, d))
    return out.groupBy("multiplier").agg(rounded(F.sum("cost")).alias("total_cost"), rounded(F.sum("strat_ret")).alias("total_return"))


def _metrics_sql(source: str, key: str, part: str) -> str:
    """Metrics over a relation (key, date, r, w)."""
    p = f"PARTITION BY {key} ORDER BY date"
    return f"""me1 AS (SELECT *, sum(ln(1 + r)) OVER ({p}) AS le, abs(w - lag(w) OVER ({p})) AS dw FROM {source}),
me2 AS (SELECT *, exp(le - max(le) OVER ({p})) - 1 AS dd FROM me1),
me3 AS (SELECT *, dd < -1e-12 AS under, sum(CASE WHEN dd < -1e-12 THEN 0 ELSE 1 END) OVER ({p}) AS resets FROM me2),
me4 AS (SELECT *, CASE WHEN under THEN sum(CASE WHEN under THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, resets ORDER BY date) ELSE 0 END AS uf FROM me3),
me5 AS (SELECT {key}, count(*) / 252.0::DOUBLE AS years, sum(ln(1 + r)) AS tot, stddev_samp(r) * sqrt(252.0) AS vol, stddev_samp(r) FILTER (WHERE r < 0) * sqrt(252.0) AS down, min(dd) AS mdd, max(uf) AS dur,
  avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(r) FILTER (WHERE r > 0) AS win, avg(r) FILTER (WHERE r < 0) AS loss, sum(dw) AS traded FROM me4 GROUP BY 1)
SELECT {part}, {r6('exp(tot / years) - 1')} AS ann_return, {r6('vol')} AS ann_vol, {r6('(exp(tot / years) - 1) / vol')} AS sharpe, {r6('(exp(tot / years) - 1) / down')} AS sortino, {r6('(exp(tot / years) - 1) / abs(mdd)')} AS calmar,
  {r6('mdd')} AS max_drawdown, CAST(dur AS BIGINT) AS max_drawdown_duration, {r6('hit')} AS hit_rate, {r6('win / abs(loss)')} AS payoff_ratio, {r6('coalesce(traded / years, 0)')} AS ann_turnover FROM me5"""


_METRICS = ("ann_return", "ann_vol", "sharpe", "sortino", "calmar", "max_drawdown", "hit_rate", "payoff_ratio", "ann_turnover")


def _round_metrics(df, *keys):
    return df.select(*keys, *[rounded(c).alias(c) for c in _METRICS], "max_drawdown_duration")


@query("economic_metrics", sql(LVL, SEG, SHIP, PAIR, PANEL, RET, STRAT_IN, STRAT, "mi AS (SELECT 'orders' AS series_id, date, held * ret - cost AS r, weight AS w FROM sr)", f"mx AS (WITH {_metrics_sql('mi', 'series_id', 'series_id')})", "SELECT * FROM mx"))
def economic_metrics(spark, d):
    return _round_metrics(signals.economic_metrics(signals.priced_returns(_strategy_inputs(spark, d))), "series_id")


BENCH = f"bi AS (SELECT pn.date, sigma, ret, {_rank('level', 60, 8)} AS lp, {_rank('vol', 60, 8)} AS vp FROM pn JOIN ret USING (date))"


@query("benchmark_metrics", sql(LVL, SEG, SHIP, PAIR, PANEL, RET, BENCH,
    "bw AS (SELECT 'buy_hold' AS book, date, sigma, ret, 1.0::DOUBLE AS weight FROM bi UNION ALL SELECT 'level', date, sigma, ret, CASE WHEN lp > 0.85 THEN 1.0 ELSE 0.0 END FROM bi UNION ALL SELECT 'vol', date, sigma, ret, CASE WHEN vp > 0.85 THEN 1.0 ELSE 0.0 END FROM bi)",
    "bh AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY book ORDER BY date), 0.0) AS held, quantile_cont(sigma, 0.5) OVER (PARTITION BY book ORDER BY date) AS med FROM bw)",
    "mi AS (SELECT book, date, held * ret - (3.0 + 1.5 * sigma / med) / 1e4 * abs(weight - held) AS r, weight AS w FROM bh)", f"mx AS (WITH {_metrics_sql('mi', 'book', 'book')})", "SELECT * FROM mx"))
def benchmark_metrics(spark, d):
    return _round_metrics(benchmark_books(spark, d), "book")


def benchmark_books(spark, d):
    panel = dislocation_panel(spark, d).where("ret IS NOT NULL")
    ranked = rolling.percentile_rank(rolling.percentile_rank(panel, 60, 8, "level", "lp"), 60, 8, "vol", "vp")
    above = lambda c: F.when(F.col(c) > 0.85, 1.0).otherwise(0.0)
    books = F.explode(F.array(*[F.struct(F.lit(b).alias("book"), w.alias("weight")) for b, w in (("buy_hold", F.lit(1.0)), ("level", above("lp")), ("vol", above("vp")))]))
    stacked = ranked.select("*", books.alias("e")).select("*", "e.book", "e.weight").drop("e")
    return signals.economic_metrics(signals.priced_returns(stacked, keys=["book"]), ["book"])


#: The signal on moving deviations instead of fitted volatilities.
_RV = [
    "rp AS (SELECT date, CASE WHEN count(ch) OVER w >= 15 THEN stddev_samp(ch) OVER w END AS vol FROM (SELECT date, value - lag(value) OVER (ORDER BY date) AS ch FROM ship) WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))",
    "rl AS (SELECT date, CASE WHEN count(ch) OVER w >= 15 THEN stddev_samp(ch) OVER w END AS sigma FROM (SELECT date, value - lag(value) OVER (ORDER BY date) AS ch FROM lvl) WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))",
    "ru AS (SELECT date, vol, lvl.value AS level, sigma, a / b AS fundamental FROM rp FULL JOIN lvl USING (date) FULL JOIN rl USING (date) FULL JOIN pair USING (date))",
    "rf AS (SELECT date, last_value(vol IGNORE NULLS) OVER w AS vol, last_value(level IGNORE NULLS) OVER w AS level, last_value(fundamental IGNORE NULLS) OVER w AS fundamental, last_value(sigma IGNORE NULLS) OVER w AS sigma FROM ru WINDOW w AS (ORDER BY date))",
    "rn2 AS (SELECT * FROM rf WHERE vol IS NOT NULL AND level IS NOT NULL AND fundamental IS NOT NULL AND sigma IS NOT NULL)",
    f"rr AS (SELECT *, {_rank('vol', 250, 250)} AS p_vol, {_rank('level', 250, 250)} AS p_level, {_rank('fundamental', 250, 250)} AS p_fund FROM rn2)",
    "rs2 AS (SELECT *, greatest(-1.0, least(1.0, (0.5 * p_vol + 0.5 * p_level) * (1 - p_fund) - (1 - (0.5 * p_vol + 0.5 * p_level)) * p_fund)) AS score FROM rr WHERE p_vol IS NOT NULL AND p_level IS NOT NULL AND p_fund IS NOT NULL)",
    "rw AS (SELECT date, sigma, greatest(-1.0, least(1.0, 0.1 * score / sigma)) AS weight FROM rs2)",
    "rh AS (SELECT *, coalesce(lag(weight) OVER (ORDER BY date), 0.0) AS held, quantile_cont(sigma, 0.5) OVER (ORDER BY date) AS med FROM (SELECT rw.*, ret FROM rw JOIN ret USING (date)))",
    "mr AS (SELECT 'realised_vol' AS book, date, held * ret - (3.0 + 1.5 * sigma / med) / 1e4 * abs(weight - held) AS r, weight AS w FROM rh)",
]


def realised_panel(spark, d, window: int = 60, least: int = 15):
    """The signal's inputs with moving deviations of changes in place of volatilities."""
    price = rolling.rolling_std(returns.changes(src.ship_prices(spark, d)), window, "change", "vol", least).select("date", "vol")
    days = rolling.rolling_std(returns.changes(src.order_days(spark, d, PAIRED)), window, "change", "sigma", least)
    scaled = rounded(0.01 * F.ln(F.col("value") / F.lag("value").over(over())), 8)
    days = days.select("date", F.col("value").alias("level"), "sigma", (F.col("a") / F.col("b")).alias("fundamental"), scaled.alias("ret"))
    joined = price.join(days, "date", "full").withColumn("series_id", F.lit("orders"))
    return cal.union_fill(joined, ["vol", "level", "fundamental", "sigma"], keep=("ret",))


def realised_book(spark, d):
    history = signals.score_history(realised_panel(spark, d), 250, scoring=_rounded_score)
    inputs = history.where("ret IS NOT NULL").withColumn("book", F.lit("realised_vol"))
    return signals.economic_metrics(signals.priced_returns(inputs, keys=["book"]), ["book"])


@query("realised_vol_benchmark", sql(LVL, SEG, SHIP, PAIR, RET, *_RV, f"mx AS (WITH {_metrics_sql('mr', 'book', 'book')})", "SELECT * FROM mx"))
def realised_vol_benchmark(spark, d):
    return _round_metrics(realised_book(spark, d), "book")


@query("quintile_forward_returns", sql(LVL, RET, "q AS (SELECT value AS score, exp(sum(ln(1 + ret)) OVER w) - 1 AS f, count(ret) OVER w AS c FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))",
    "v AS (SELECT * FROM q WHERE c = 5)", "e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS ed FROM v)", "b AS (SELECT 1 + len(list_filter(ed, lambda x: x < score)) AS quintile, f FROM v, e)",
    f"SELECT CAST(g.q AS INTEGER) AS quintile, {r6('avg(f)')} AS mean, count(f) AS n FROM (SELECT unnest([1, 2, 3, 4, 5]) AS q) g LEFT JOIN b ON b.quintile = g.q GROUP BY 1"))
def quintile_forward_returns(spark, d):
    fwd = returns.forward_returns(order_returns(spark, d), 5, "fwd")
    return signals.quintiles(fwd, "value", "fwd").select("quintile", rounded("mean").alias("mean"), "n")


@query("worst_month", sql(LVL, RET, "m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(ret) AS total FROM ret GROUP BY 1)", f"SELECT month, {r6('total')} AS total FROM m ORDER BY total, month LIMIT 1"))
def worst_month(spark, d):
    return signals.worst_month(order_returns(spark, d)).select("month", rounded("total").alias("total"))


@query("first_value_cv", sql(LVL, "m AS (SELECT min_by(value, date) AS v FROM lvl GROUP BY date_trunc('month', date))", f"SELECT {r6('stddev_samp(v) / abs(avg(v))')} AS cv, stddev_samp(v) / abs(avg(v)) > 0.15 AS unstable FROM m"))
def first_value_cv(spark, d):
    return signals.first_value_cv(src.orders_levels(spark, d), "value").select(rounded("cv").alias("cv"), "unstable")


_H = 5
_MEAT = "sum(u * u) + " + " + ".join(f"2 * (1 - {k} / 6.0::DOUBLE) * coalesce(sum(u * u{k}), 0)" for k in range(1, _H + 1))


@query("predictive_regression_hac", sql(LVL, RET, "q AS (SELECT date, value AS x, exp(sum(ln(1 + ret)) OVER w) - 1 AS y, count(ret) OVER w AS c FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))",
    "v AS (SELECT date, x, y FROM q WHERE c = 5)", "f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM v)",
    "e AS (SELECT date, y - a - b * x AS e, (x - mx) * (y - a - b * x) AS u FROM v, f)", f"l AS (SELECT e, u, {', '.join(f'lag(u, {k}) OVER (ORDER BY date) AS u{k}' for k in range(1, _H + 1))} FROM e)",
    f"s AS (SELECT {_MEAT} AS meat, sum(e * e) AS sse FROM l)", "z AS (SELECT *, sqrt(greatest(meat, 0) / (sxx * sxx) * n / (n - 2)) AS hac, sqrt(sse / (n - 2) / sxx) AS ols FROM f, s)",
    f"SELECT n, {r6('a')} AS intercept, {r6('b')} AS beta, {r6('greatest(hac, ols)')} AS se, {r6('b / greatest(hac, ols)')} AS t_stat, {r6('r2')} AS r2 FROM z"))
def predictive_regression_hac(spark, d):
    out = stats.predictive_regression(returns.forward_returns(order_returns(spark, d), 5, "fwd"), "fwd", "value", _H)
    return out.select("n", *[rounded(c).alias(c) for c in ("intercept", "beta", "se", "t_stat", "r2")])


NUMR = "nr AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM ret)"
EW = "ew AS (SELECT date, i, ret, ret * ret AS v FROM nr WHERE i = 1 UNION ALL SELECT n.date, n.i, n.ret, 0.94 * ew.v + 0.06 * ew.ret * ew.ret FROM ew JOIN nr n ON n.i = ew.i + 1)"


def _sigma(spark, d):
    return folds.ewma_vol(order_returns(spark, d))


@query("leverage_sign_means", sql(LVL, RET, NUMR, EW, "dl AS (SELECT ret, ln(sqrt(lead(v) OVER (ORDER BY i)) / sqrt(v)) AS g FROM ew)", "c AS (SELECT quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM ew)",
    f"SELECT {r6('avg(g) FILTER (WHERE ret <= lo)')} AS after_low, {r6('avg(g) FILTER (WHERE ret >= hi)')} AS after_high, count(*) FILTER (WHERE ret <= lo) AS n_low, count(*) FILTER (WHERE ret >= hi) AS n_high FROM dl, c WHERE g IS NOT NULL", recursive=True))
def leverage_sign_means(spark, d):
    return stats.leverage_sign(_sigma(spark, d)).select(rounded("after_low").alias("after_low"), rounded("after_high").alias("after_high"), "n_low", "n_high")


@query("layer_comparison", sql(SEG, "p AS (SELECT date, max(value) FILTER (WHERE series_id = 'AUTOMOBILE') AS a, max(value) FILTER (WHERE series_id = 'BUILDING') AS b, max(value) FILTER (WHERE series_id = 'MACHINERY') AS c FROM seg GROUP BY 1)",
    f"SELECT count(*) AS n, {r6('corr(a, b)')} AS ab, {r6('corr(a, c)')} AS ac, {r6('corr(b, c)')} AS bc, least(corr(a, b), corr(a, c), corr(b, c)) < 0.3 AS artifact FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"))
def layer_comparison(spark, d):
    out = signals.layer_comparison(src.segment_levels(spark, d), ["AUTOMOBILE", "BUILDING", "MACHINERY"])
    return out.select("n", rounded(F.col("`AUTOMOBILE|BUILDING`")).alias("ab"), rounded(F.col("`AUTOMOBILE|MACHINERY`")).alias("ac"), rounded(F.col("`BUILDING|MACHINERY`")).alias("bc"), "artifact")


# --- regimes ----------------------------------------------------------------------------------------------

REGIME_IN = f"pi AS (SELECT date, {_rank('log_rv', 60, 60)} AS p FROM (SELECT date, CASE WHEN count(ret) OVER w = 5 THEN round(ln(sum(ret * ret) OVER w), 6) END AS log_rv FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))), rn AS (SELECT date, p, day(date) % 2 = 0 AS exo, row_number() OVER (ORDER BY date) AS i FROM pi WHERE p IS NOT NULL)"
_A, _B = "CASE WHEN n.p > 0.7 THEN r.ab + 1 ELSE 0 END", "CASE WHEN n.p < 0.3 THEN r.be + 1 ELSE 0 END"
_TURN = f"((CASE WHEN r.st THEN {_B} ELSE {_A} END) >= 2 AND r.dy >= 5)"
REGIME = f"""rg AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, false AS st, CAST(5 AS INTEGER) AS dy, CAST(0 AS INTEGER) AS ab, CAST(0 AS INTEGER) AS be, false AS exo UNION ALL
  SELECT n.i, n.date, r.st <> {_TURN}, CAST(CASE WHEN {_TURN} THEN 1 ELSE r.dy + 1 END AS INTEGER), CAST({_A} AS INTEGER), CAST({_B} AS INTEGER), n.exo FROM rg r JOIN rn n ON n.i = r.i + 1),
rs AS (SELECT i, date, st AS stressed, dy AS days_in, CASE WHEN NOT st THEN 0.0 WHEN exo THEN 1.0 ELSE 0.5 END AS derisk FROM rg WHERE i > 0)"""


def regime_states(spark, d):
    rv = returns.log_realised_variance(order_returns(spark, d), 5).withColumn("log_rv", F.round("log_rv", 6))
    p = rolling.percentile_rank(rv, 60, 60, "log_rv", "p_stress").where("p_stress IS NOT NULL")
    return folds.anti_chattering(p.select("series_id", "date", "p_stress", (F.dayofmonth("date") % 2 == 0).alias("confirms")))


@query("anti_chattering_states", sql(LVL, RET, REGIME_IN, REGIME, "SELECT date, stressed, days_in, CAST(derisk AS DOUBLE) AS derisk FROM rs", recursive=True))
def anti_chattering_states(spark, d):
    return regime_states(spark, d).select("date", "stressed", "days_in", "derisk")


@query("regime_transition_stats", sql(LVL, RET, REGIME_IN, REGIME, "rt AS (SELECT *, lag(stressed) OVER (ORDER BY i) AS pv FROM rs)",
    f"""SELECT count(*) AS n, CAST(count(*) FILTER (WHERE pv IS NOT NULL AND stressed <> pv) AS BIGINT) AS n_transitions, {r6("count(*) FILTER (WHERE pv IS NOT NULL AND stressed <> pv) / (count(*) / 252.0)")} AS per_year,
  CAST(count(*) FILTER (WHERE stressed AND NOT coalesce(pv, false)) AS BIGINT) AS n_episodes, {r6("count(*) FILTER (WHERE stressed) / CAST(count(*) FILTER (WHERE stressed AND NOT coalesce(pv, false)) AS DOUBLE)")} AS mean_duration,
  count(*) FILTER (WHERE derisk = 0.5) AS partial_days, count(*) FILTER (WHERE derisk = 1) AS full_days FROM rt""", recursive=True))  # fmt: skip
def regime_transition_stats(spark, d):
    out = risk.transition_stats(regime_states(spark, d))
    return out.select("n", "n_transitions", rounded("per_year").alias("per_year"), "n_episodes", rounded("mean_duration").alias("mean_duration"), "partial_days", "full_days")


@query("state_transitions", sql(SEG, SRET, "ts AS (SELECT series_id, date, CASE WHEN ret < -0.003 THEN 'fall' WHEN ret < 0 THEN 'slip' WHEN ret < 0.003 THEN 'gain' ELSE 'jump' END AS s FROM sret)", "tp AS (SELECT series_id, lag(s) OVER (PARTITION BY series_id ORDER BY date) AS from_state, s AS to_state FROM ts)",
    f"SELECT series_id, from_state, to_state, count(*) AS n, {r6('count(*) / CAST(sum(count(*)) OVER (PARTITION BY series_id, from_state) AS DOUBLE)')} AS p FROM tp WHERE from_state IS NOT NULL GROUP BY 1, 2, 3"))
def state_transitions(spark, d):
    """How four states of the segments' changes follow each other."""
    x = F.col("ret")
    states = segment_returns(spark, d).withColumn("state", F.when(x < -0.003, "fall").when(x < 0, "slip").when(x < 0.003, "gain").otherwise("jump"))
    return risk.state_transitions(states).withColumn("p", rounded("p"))


@query("regime_transition_matrix", sql(LVL, RET, REGIME_IN, REGIME, "rt AS (SELECT stressed AS s, lag(stressed) OVER (ORDER BY i) AS pv FROM rs)", "pm AS (SELECT count(*) FILTER (WHERE NOT pv AND NOT s) / CAST(count(*) FILTER (WHERE NOT pv) AS DOUBLE) AS p00, count(*) FILTER (WHERE pv AND s) / CAST(count(*) FILTER (WHERE pv) AS DOUBLE) AS p11 FROM rt)",
    f"SELECT {r6('p00')} AS p00, {r6('p11')} AS p11, {r6('1 / (1 - p00)')} AS calm_duration, {r6('1 / (1 - p11)')} AS stress_duration, {r6('(1 - p00) / (2 - p00 - p11)')} AS stationary_stress FROM pm", recursive=True))
def regime_transition_matrix(spark, d):
    out = risk.transition_matrix(regime_states(spark, d))
    return out.select(*[rounded(c).alias(c) for c in ("p00", "p11", "calm_duration", "stress_duration", "stationary_stress")])


CONC = "cc AS (SELECT rs.date, rs.i, stressed AS ms, active AS legacy FROM rs JOIN hy USING (date))"


def _two_regimes(spark, d):
    flags = _flags(spark, d).select("date", F.col("active").alias("legacy"))
    return regime_states(spark, d).withColumnRenamed("stressed", "ms").join(flags, "date")


@query("regime_concordance", sql(LVL, RET, HYST, REGIME_IN, REGIME, CONC, f"SELECT {r6('avg(CASE WHEN ms = legacy THEN 1.0 ELSE 0.0 END)')} AS concordance, count(*) FILTER (WHERE ms AND NOT legacy) AS only_first, count(*) FILTER (WHERE legacy AND NOT ms) AS only_second, count(*) AS n FROM cc", recursive=True))
def regime_concordance(spark, d):
    return risk.regime_concordance(_two_regimes(spark, d)).select(rounded("concordance").alias("concordance"), "only_first", "only_second", "n")


@query("regime_episode_leads", sql(LVL, RET, HYST, REGIME_IN, REGIME, CONC, EPS, "nn AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM cc)",
    "ee AS (SELECT episode, min(k) FILTER (WHERE ms) AS ia, min(k) FILTER (WHERE legacy) AS ib, min(date) FILTER (WHERE ms) AS first_a, min(date) FILTER (WHERE legacy) AS first_b FROM nn JOIN ep ON date BETWEEN s AND e GROUP BY 1)",
    "SELECT episode, first_a, first_b, CAST(ib - ia AS INTEGER) AS lead_rows, CASE WHEN ia < ib THEN 'ms' WHEN ib < ia THEN 'legacy' END AS leader FROM ee", recursive=True))
def regime_episode_leads(spark, d):
    return risk.episode_leads(_two_regimes(spark, d), episodes_frame(spark))


# --- overlay ----------------------------------------------------------------------------------------------


def overlay_inputs(spark, d):
    sigma = rolling.rolling_std(order_returns(spark, d), 20, "ret", "s").where("s IS NOT NULL AND s > 0")
    annual = risk.annualised(sigma, "s").withColumn("es", 2.5 * F.col("s"))
    both = _two_regimes(spark, d)
    inputs = risk.overlay_inputs(annual, annual, both.select("date", F.col("ms").alias("stressed"), "confirms"), both.select("date", "legacy"))
    return inputs.join(order_returns(spark, d).select("date", "ret"), "date")


OV_IN = "oi AS (SELECT r.date, ret, s * sqrt(252.0) AS sigma_ann, 2.5 * s AS es, rs.stressed, day(r.date) % 2 = 0 AS confirms, hy.active AS legacy FROM (SELECT date, ret, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS s FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) r JOIN rs USING (date) JOIN hy USING (date) WHERE s > 0)"
OV_M = "om AS (SELECT *, least(1.0, 0.1 / sigma_ann) AS m_vol, least(1.0, 0.025 / es) AS m_es, CASE WHEN NOT stressed THEN 1.0 WHEN confirms THEN 0.5 ELSE 0.75 END AS m_reg, CASE WHEN legacy THEN 0.5 ELSE 1.0 END AS m_leg, CASE WHEN legacy AND stressed THEN 0.5 ELSE 1.0 END AS m_both FROM oi)"
OV_B = "ob AS (SELECT book, date, CAST(greatest(0.0, least(1.0, raw)) AS DOUBLE) AS raw, row_number() OVER (PARTITION BY book ORDER BY date) AS i FROM (SELECT 'base' AS book, date, 1.0 AS raw FROM om UNION ALL SELECT 'vol_only', date, m_vol FROM om UNION ALL SELECT 'full_ms', date, least(m_vol, m_es, m_reg) FROM om UNION ALL SELECT 'full_legacy', date, least(m_vol, m_es, m_leg) FROM om UNION ALL SELECT 'conjunction', date, least(m_vol, m_es, m_both) FROM om))"
OV_F = "of AS (SELECT book, date, i, raw, raw AS sm, raw AS ex FROM ob WHERE i = 1 UNION ALL SELECT n.book, n.date, n.i, n.raw, 0.3 * n.raw + 0.7 * f.sm, CASE WHEN abs(0.3 * n.raw + 0.7 * f.sm - f.ex) > 0.05 THEN 0.3 * n.raw + 0.7 * f.sm ELSE f.ex END FROM of f JOIN ob n ON n.book = f.book AND n.i = f.i + 1)"
OVERLAY = [LVL, RET, HYST, REGIME_IN, REGIME, OV_IN, OV_M]


@query("overlay_books", sql(*OVERLAY, OV_B, OV_F, f"SELECT book, date, {r6('raw')} AS raw, {r6('sm')} AS smooth, {r6('ex')} AS executed FROM of", recursive=True))
def overlay_books(spark, d):
    out = risk.books(risk.multipliers(overlay_inputs(spark, d)))
    return out.select("book", "date", *[rounded(c).alias(c) for c in ("raw", "smooth", "executed")])


@query("overlay_binding", sql(*OVERLAY, "b AS (SELECT *, least(m_vol, m_es, m_reg) AS m FROM om)", "c AS (SELECT *, abs(m_vol - m) <= 1e-12 AS v, abs(m_es - m) <= 1e-12 AS e, abs(m_reg - m) <= 1e-12 AS g FROM b)",
    f"SELECT date, {r6('m')} AS m_raw, CASE WHEN CAST(v AS INT) + CAST(e AS INT) + CAST(g AS INT) > 1 THEN 'tie' WHEN v THEN 'vol' WHEN e THEN 'es' WHEN g THEN 'regime' ELSE 'clip' END AS binding FROM c", recursive=True))
def overlay_binding(spark, d):
    return risk.binding(risk.multipliers(overlay_inputs(spark, d))).select("date", rounded("m_raw").alias("m_raw"), "binding")


@query("overlay_metrics", sql(*OVERLAY, OV_B, OV_F, "mo AS (SELECT book, date, ex * ret AS r, ex AS w FROM of JOIN om USING (date))", f"mt AS (WITH {_metrics_sql('mo', 'book', 'book')})",
    f"SELECT *, {r6("ann_turnover - max(ann_turnover) FILTER (WHERE book = 'base') OVER ()")} AS incremental_turnover, ann_turnover - max(ann_turnover) FILTER (WHERE book = 'base') OVER () > 2 AS turnover_alarm FROM mt", recursive=True))
def overlay_metrics(spark, d):
    out = risk.overlay_metrics(risk.books(risk.multipliers(overlay_inputs(spark, d))))
    rows = _round_metrics(out, "book", "turnover_alarm")
    base = F.max(F.when(F.col("book") == "base", F.col("ann_turnover"))).over(Window.partitionBy())  # five rows
    return rows.withColumn("incremental_turnover", rounded(F.col("ann_turnover") - base))


@query("overlay_backtest", sql(*OVERLAY, OV_B, OV_F, f"SELECT book, count(*) AS n, {r6('sum(ex * ret)')} AS pnl, {r6('stddev_samp(ex * ret) * sqrt(252.0)')} AS ann_vol FROM of JOIN om USING (date) GROUP BY 1", recursive=True))
def overlay_backtest(spark, d):
    out = risk.books(risk.multipliers(overlay_inputs(spark, d))).withColumn("pnl", F.col("executed") * F.col("ret"))
    return out.groupBy("book").agg(F.count("*").alias("n"), rounded(F.sum("pnl")).alias("pnl"), rounded(F.stddev_samp("pnl") * 252**0.5).alias("ann_vol"))


def overlay_grid(spark, d):
    """The full book on a grid of kappa, target volatility and band: one fold a grid cell, in parallel."""
    cells = [(float(k), float(t), float(b)) for k in (0.25, 0.5, 0.75) for t in (0.05, 0.1, 0.15) for b in (0.02, 0.05, 0.1)]
    grid = F.broadcast(spark.createDataFrame(cells, "kappa double, target double, band double"))
    m = risk.multipliers(overlay_inputs(spark, d).crossJoin(grid), F.col("target"), 0.025, F.col("kappa"))
    raw = m.withColumn("raw", F.least("m_vol", "m_es", "m_regime"))
    return folds.smooth_and_hold(raw, "raw", 0.3, F.col("band"), ["kappa", "target", "band"])


@query("overlay_grid_sensitivity", sql(*OVERLAY, "gr AS (SELECT k AS kappa, t AS target, b AS band FROM (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS k), (SELECT unnest([0.05::DOUBLE, 0.1, 0.15]) AS t), (SELECT unnest([0.02::DOUBLE, 0.05, 0.1]) AS b))",
    "gi AS (SELECT kappa, target, band, date, ret, least(1.0, target / sigma_ann, 0.025 / es, CASE WHEN NOT stressed THEN 1.0 WHEN confirms THEN kappa ELSE 1 - (1 - kappa) / 2 END) AS raw, row_number() OVER (PARTITION BY kappa, target, band ORDER BY date) AS i FROM oi, gr)",
    "gf AS (SELECT kappa, target, band, i, ret, raw AS sm, raw AS ex FROM gi WHERE i = 1 UNION ALL SELECT n.kappa, n.target, n.band, n.i, n.ret, 0.3 * n.raw + 0.7 * f.sm, CASE WHEN abs(0.3 * n.raw + 0.7 * f.sm - f.ex) > n.band THEN 0.3 * n.raw + 0.7 * f.sm ELSE f.ex END FROM gf f JOIN gi n ON n.kappa = f.kappa AND n.target = f.target AND n.band = f.band AND n.i = f.i + 1)",
    f"SELECT kappa, target, band, {r6('sum(ex * ret)')} AS pnl, {r6('avg(ex)')} AS mean_multiplier FROM gf GROUP BY 1, 2, 3", recursive=True))
def overlay_grid_sensitivity(spark, d):
    out = overlay_grid(spark, d)
    return out.groupBy("kappa", "target", "band").agg(rounded(F.sum(F.col("executed") * F.col("ret"))).alias("pnl"), rounded(F.avg("executed")).alias("mean_multiplier"))


_CELLS = [
    "gr AS (SELECT k AS kappa, t AS target FROM (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS k), (SELECT unnest([0.05::DOUBLE, 0.1, 0.15]) AS t))",
    "gi AS (SELECT kappa, target, date, ret, least(1.0, target / sigma_ann, 0.025 / es, CASE WHEN NOT stressed THEN 1.0 WHEN confirms THEN kappa ELSE 1 - (1 - kappa) / 2 END) AS raw, row_number() OVER (PARTITION BY kappa, target ORDER BY date) AS i FROM oi, gr)",
    "gf AS (SELECT kappa, target, date, i, ret, raw AS sm, raw AS ex FROM gi WHERE i = 1 UNION ALL SELECT n.kappa, n.target, n.date, n.i, n.ret, 0.3 * n.raw + 0.7 * f.sm, CASE WHEN abs(0.3 * n.raw + 0.7 * f.sm - f.ex) > 0.05 THEN 0.3 * n.raw + 0.7 * f.sm ELSE f.ex END FROM gf f JOIN gi n ON n.kappa = f.kappa AND n.target = f.target AND n.i = f.i + 1)",
    "mc AS (SELECT CAST(kappa AS VARCHAR) || '|' || CAST(target AS VARCHAR) AS cell, date, ex * ret AS r, ex AS w FROM gf)",
]


@query("overlay_sharpe_pivot", sql(*OVERLAY, *_CELLS, f"mt AS (WITH {_metrics_sql('mc', 'cell', 'cell')})", "sp AS (SELECT CAST(split_part(cell, '|', 1) AS DOUBLE) AS kappa, split_part(cell, '|', 2) AS target, sharpe FROM mt)",
    "SELECT kappa, max(sharpe) FILTER (WHERE target = '0.05') AS target_05, max(sharpe) FILTER (WHERE target = '0.1') AS target_10, max(sharpe) FILTER (WHERE target = '0.15') AS target_15 FROM sp GROUP BY 1", recursive=True))
def overlay_sharpe_pivot(spark, d):
    """Sharpe ratios of the full book by kappa and target volatility, at the usual band."""
    cells = overlay_grid(spark, d).where("band = 0.05").withColumn("pnl", F.col("executed") * F.col("ret"))
    per = signals.economic_metrics(cells, ["kappa", "target"], column="pnl", weight="executed")
    table = per.groupBy("kappa").pivot("target", [0.05, 0.1, 0.15]).agg(F.max(rounded("sharpe")))
    return table.toDF("kappa", "target_05", "target_10", "target_15")


@query("detection_lags", sql(LVL, RET, REGIME_IN, REGIME, "dp AS (SELECT rs.i, rs.date, stressed, p > 0.7 AS above, stressed AND NOT coalesce(lag(stressed) OVER (ORDER BY rs.i), false) AS began FROM rs JOIN rn ON rn.i = rs.i)",
    "db AS (SELECT *, coalesce(max(CASE WHEN NOT above THEN i END) OVER (ORDER BY i), 0) AS below FROM dp)", "SELECT date, CAST(CASE WHEN above THEN i - below - 1 ELSE -1 END AS INTEGER) AS lag FROM db WHERE began", recursive=True))
def detection_lags(spark, d):
    return risk.detection_lags(regime_states(spark, d)).select("date", "lag")


@query("correlation_pair", sql(SEG, SRET, "p AS (SELECT x.ret AS a, y.ret AS b FROM sret x JOIN sret y ON x.date = y.date AND x.series_id = 'AUTOMOBILE' AND y.series_id = 'BUILDING')", f"SELECT {r6('corr(a, b)')} AS corr, count(*) AS n FROM p"))
def correlation_pair(spark, d):
    r = segment_returns(spark, d)
    a, b = (r.where(F.col("series_id") == s).select("date", F.col("ret").alias(c)) for s, c in (("AUTOMOBILE", "a"), ("BUILDING", "b")))
    return a.join(b, "date").agg(rounded(safe_corr(F.col("a"), F.col("b"))).alias("corr"), F.count("*").alias("n"))


@query("failure_flags", sql(LVL, SEG, SHIP, PAIR, PANEL, RET, STRAT_IN, STRAT, BENCH,
    "mi1 AS (SELECT 'orders' AS series_id, date, held * ret - cost AS r, weight AS w FROM sr)", "mi3 AS (SELECT 'orders' AS series_id, date, held * ret - 3 * cost AS r, weight AS w FROM sr)",
    "bw AS (SELECT 'buy_hold' AS book, date, sigma, ret, 1.0::DOUBLE AS weight FROM bi UNION ALL SELECT 'level', date, sigma, ret, CASE WHEN lp > 0.85 THEN 1.0 ELSE 0.0 END FROM bi UNION ALL SELECT 'vol', date, sigma, ret, CASE WHEN vp > 0.85 THEN 1.0 ELSE 0.0 END FROM bi)",
    "bh AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY book ORDER BY date), 0.0) AS held, quantile_cont(sigma, 0.5) OVER (PARTITION BY book ORDER BY date) AS med FROM bw)",
    "mib AS (SELECT book, date, held * ret - (3.0 + 1.5 * sigma / med) / 1e4 * abs(weight - held) AS r, weight AS w FROM bh)",
    f"x1 AS (WITH {_metrics_sql('mi1', 'series_id', 'series_id')})", f"x3 AS (WITH {_metrics_sql('mi3', 'series_id', 'series_id')})", f"xb AS (WITH {_metrics_sql('mib', 'book', 'book')})",
    "fe AS (SELECT e, min(date) AS b, max(date) AS f FROM (SELECT *, sum(CASE WHEN active AND NOT coalesce(pa, false) THEN 1 ELSE 0 END) OVER (ORDER BY date) AS e FROM (SELECT dh.date, active, lag(active) OVER (ORDER BY dh.date) AS pa FROM dh JOIN ret USING (date))) WHERE active GROUP BY 1)",
    "fn AS (SELECT count(*) FILTER (WHERE coalesce(date_diff('day', pf, b) >= 60, true)) AS n FROM (SELECT b, lag(f) OVER (ORDER BY b) AS pf FROM fe))",
    "fq AS (SELECT date, score AS x, exp(sum(ln(1 + ret)) OVER w) - 1 AS y, count(ret) OVER w AS c FROM (SELECT dh.date, score, ret FROM dh JOIN ret USING (date)) WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))",
    "fv AS (SELECT date, x, y FROM fq WHERE c = 5)", "ff AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM fv)",
    "fu AS (SELECT date, y - a - b * x AS e, (x - mx) * (y - a - b * x) AS u FROM fv, ff)", f"fl2 AS (SELECT e, u, {', '.join(f'lag(u, {k}) OVER (ORDER BY date) AS u{k}' for k in range(1, _H + 1))} FROM fu)",
    f"fs AS (SELECT {_MEAT} AS meat, sum(e * e) AS sse FROM fl2)", "ft AS (SELECT b, b / greatest(sqrt(greatest(meat, 0) / (sxx * sxx) * n / (n - 2)), sqrt(sse / (n - 2) / sxx)) AS t FROM ff, fs)",
    *_RV, f"xr AS (WITH {_metrics_sql('mr', 'book', 'book')})", "fed AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS ed FROM fv)", "fqm AS (SELECT 1 + len(list_filter(ed, lambda e: e < x)) AS quintile, avg(y) AS m FROM fv, fed GROUP BY 1)", "fst AS (SELECT m - lag(m) OVER (ORDER BY quintile) AS step FROM fqm)",
    "SELECT x1.series_id, x1.sharpe <= 0 AS no_reward, x1.sharpe < (SELECT max(sharpe) FROM xb) AS beaten_by_benchmark, x3.ann_return <= 0 AS not_implementable, (SELECT n FROM fn) < 5 AS too_few_episodes, abs(t) < 1.96 AS not_significant, b <= 0 AS wrong_sign, x1.max_drawdown < -0.5 AS deep_drawdown, x1.payoff_ratio < 1 AS poor_payoff, (SELECT coalesce(min(step) < 0, false) FROM fst) AS quintiles_not_monotone, coalesce((SELECT max(sharpe) FROM xr) >= x1.sharpe, false) AS beaten_by_realised_vol, coalesce(x1.ann_return < (SELECT max(ann_return) FROM xb WHERE book = 'buy_hold'), false) AS beaten_by_buy_hold FROM x1, x3, ft"))
def failure_flags(spark, d):
    inputs = written(_strategy_inputs(spark, d))
    metrics = signals.economic_metrics(signals.priced_returns(inputs))
    triple = signals.economic_metrics(signals.priced_returns(inputs, multiplier=3.0))
    fwd = returns.forward_returns(inputs.select("series_id", "date", "score", "ret"), 5, "fwd")
    books = benchmark_books(spark, d).unionByName(realised_book(spark, d))
    return signals.failure_flags(metrics, books, triple, rolling.independent_episodes(inputs), stats.predictive_regression(fwd, "fwd", "score", 5), signals.quintiles(fwd, "score", "fwd"))
