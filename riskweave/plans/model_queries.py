"""Queries on fitted models and simulations, and those of their parts that SQL can express given the fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import diagnostics, folds, models, returns, rolling, stats
from ..operators import volatility as vol
from ..sources import series as src
from .base_queries import order_returns, segment_returns
from .registry import LVL, MON, RET, SEG, SRET, query, r6, rounded, sql

WEIGHTS = {"AUTOMOBILE": 0.5, "BUILDING": 0.3, "MACHINERY": 0.2}
QUALITY = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "MACHINERY": 4, "HOUSEHOLD": 5}


# --- volatility ------------------------------------------------------------------------------------------


@query("gjr_fit_panel")
def gjr_fit_panel(spark, d):
    return vol.gjr_fit_panel(segment_returns(spark, d))


@query("egarch_fit_panel")
def egarch_fit_panel(spark, d):
    return vol.ranked_panel(vol.egarch_fit_panel(segment_returns(spark, d)), QUALITY)


@query("egarch_parameters")
def egarch_parameters(spark, d):
    return vol.egarch_parameters(order_returns(spark, d))


@query("egarch_forecast")
def egarch_forecast(spark, d):
    return vol.egarch_forecast(order_returns(spark, d))


@query("egarch_monthly")
def egarch_monthly(spark, d):
    """The primary layer on month ends; a synthetic sample of some eighty months is too short for the usual 120."""
    return vol.layered_egarch(cal.month_end_levels(src.orders_levels(spark, d)), least=60)


@query("egarch_daily_layer")
def egarch_daily_layer(spark, d):
    """A daily layer: it may time signals but not originate them, so residuals that aren't white are a warning."""
    return vol.layered_egarch(src.orders_levels(spark, d), "daily_full_anchor")


@query("diagnostics_post")
def diagnostics_post(spark, d):
    return diagnostics.post_estimation(order_returns(spark, d))


@query("quantile_pairs")
def quantile_pairs(spark, d):
    s = folds.gjr_filter(segment_returns(spark, d), 0.000002, 0.05, 0.1, 0.85, 0.0001)
    return diagnostics.quantile_pairs(s.withColumn("z", F.col("ret") / F.col("sigma")))


# --- simulation ------------------------------------------------------------------------------------------


@query("fhs_var_es")
def fhs_var_es(spark, d):
    return models.fhs_var_es(segment_returns(spark, d))


@query("portfolio_fhs")
def portfolio_fhs(spark, d):
    return models.portfolio_fhs(segment_returns(spark, d), WEIGHTS, horizon=10, least=500)


@query("tcopula_var")
def tcopula_var(spark, d):
    return models.tcopula_var(segment_returns(spark, d), WEIGHTS, horizon=5, least=500)


@query("var_es_draws", sql(SEG, SRET, "q AS (SELECT series_id, 0.975::DOUBLE AS alpha, quantile_cont(ret, 0.025) AS q FROM sret GROUP BY 1 UNION ALL SELECT series_id, 0.99, quantile_cont(ret, 0.01) FROM sret GROUP BY 1)",
    f"SELECT s.series_id, q.alpha, {r6('-any_value(q.q)')} AS var, {r6('-avg(ret) FILTER (WHERE ret <= q.q)')} AS es FROM sret s JOIN q USING (series_id) GROUP BY 1, 2"))
def var_es_draws(spark, d):
    """VaR and ES of draws: the returns themselves."""
    return models.var_es_of(segment_returns(spark, d)).select("series_id", "alpha", rounded("var").alias("var"), rounded("es").alias("es"))


# --- regimes ---------------------------------------------------------------------------------------------


def _log_rv(spark, d):
    return returns.log_realised_variance(order_returns(spark, d), 5)


@query("markov_regime_fit")
def markov_regime_fit(spark, d):
    return models.markov_regime_fit(_log_rv(spark, d), "log_rv")


@query("regime_report")
def regime_report(spark, d):
    return models.regime_report(_log_rv(spark, d), "log_rv")


@query("regime_report_three")
def regime_report_three(spark, d):
    return models.regime_report(_log_rv(spark, d), "log_rv", 3)


# --- disaggregation ---------------------------------------------------------------------------------------


def _daily_indicators(spark, d):
    return src.orders_levels(spark, d).join(src.ship_counts(spark, d).select("date", F.ln("value").alias("ln_vix")), "date")


@query("chow_lin_daily")
def chow_lin_daily(spark, d):
    return models.chow_lin_daily(_daily_indicators(spark, d), src.monthly_levels(spark, d), ["ln_vix"])


@query("chow_lin_asof")
def chow_lin_asof(spark, d):
    return models.chow_lin_daily(_daily_indicators(spark, d), src.monthly_levels(spark, d), ["ln_vix"], asof="1997-06-15")


@query("chow_lin_accounting", sql(LVL, MON, "vixd AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)", "m AS (SELECT DISTINCT CAST(date_trunc('month', lvl.date) AS DATE) AS month FROM lvl JOIN vixd USING (date))",
    f"SELECT 'orders' AS series_id, month, {r6('value')} AS replicated FROM m JOIN mon ON mon.date = m.month"))
def chow_lin_accounting(spark, d):
    """The monthly means of the disaggregated path: the monthly series itself."""
    path = models.chow_lin_daily(_daily_indicators(spark, d), src.monthly_levels(spark, d), ["ln_vix"])
    return cal.replicated(path, src.monthly_levels(spark, d)).select("series_id", "month", rounded("replicated").alias("replicated"))


@query("block_bootstrap_ci")
def block_bootstrap_ci(spark, d):
    return stats.block_bootstrap_ci(segment_returns(spark, d), "ret")


# --- walk-forward -----------------------------------------------------------------------------------------

_TAUS = "ta AS (SELECT date AS tau, lead(date) OVER (ORDER BY date) AS until FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS before FROM ret) WHERE before >= 500 AND date = CAST(date_trunc('month', date) AS DATE) + CASE isodow(date_trunc('month', date)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)"


@query("walk_forward_ewma", sql(LVL, RET, _TAUS, "sg AS (SELECT tau, r.date, r.ret, row_number() OVER (PARTITION BY tau ORDER BY r.date) AS i FROM ta JOIN ret r ON r.date >= tau AND (until IS NULL OR r.date < until))",
    "v0 AS (SELECT tau, avg(ret * ret) AS v FROM ta JOIN ret ON date < tau GROUP BY 1)",
    "wf AS (SELECT sg.tau, sg.date, sg.i, sg.ret, v0.v FROM sg JOIN v0 USING (tau) WHERE i = 1 UNION ALL SELECT n.tau, n.date, n.i, n.ret, 0.94 * wf.v + 0.06 * wf.ret * wf.ret FROM wf JOIN sg n ON n.tau = wf.tau AND n.i = wf.i + 1)",
    f"SELECT tau, date, {r6('sqrt(v)')} AS sigma FROM wf", recursive=True))
def walk_forward_ewma(spark, d):
    r = order_returns(spark, d)
    out = models.walk_forward(r, cal.reestimation_dates(r, 500), models.ewma_estimate, models.ewma_filtered)
    return out.select("tau", "date", rounded("sigma").alias("sigma"))


@query("walk_forward_gjr")
def walk_forward_gjr(spark, d):
    """Monthly refits of a GJR variance, its path and its parameters' trajectory."""
    r, spec = order_returns(spark, d), vol.Spec("gjr")
    return models.walk_forward(r, cal.reestimation_dates(r, 500), models.fitted_estimate(spec), models.fitted_sigmas(spec), ("omega", "alpha", "gamma", "beta"))


@query("filtered_var_path", sql(LVL, RET, "nr AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM ret)", "ew AS (SELECT date, i, ret, CAST(0.0001 AS DOUBLE) AS v FROM nr WHERE i = 1 UNION ALL SELECT n.date, n.i, n.ret, 0.94 * ew.v + 0.06 * ew.ret * ew.ret FROM ew JOIN nr n ON n.i = ew.i + 1)",
    "zz AS (SELECT date, sqrt(v) AS sigma, ret / sqrt(v) AS z FROM ew)", f"SELECT date, CASE WHEN count(z) OVER w >= 20 THEN {r6('-sigma * quantile_cont(z, 0.05) OVER w')} END AS var_fhs FROM zz WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", recursive=True))
def filtered_var_path(spark, d):
    """Expanding-quantile VaR on EWMA-standardised returns."""
    s = folds.ewma_vol(order_returns(spark, d), first_var=1e-4)
    out = rolling.filtered_var(s.withColumn("mu", F.lit(0.0)).withColumn("z", F.col("ret") / F.col("sigma")), 0.95)
    return out.select("date", rounded("var_fhs").alias("var_fhs"))
