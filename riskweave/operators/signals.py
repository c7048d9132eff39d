"""Dislocation score, positions, costs, performance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import over, require, so_far
from .blocks import rolling_ranks
from .folds import hysteresis
from .rolling import expanding_median

Scoring = Callable[[Column, Column, Column], Column]


def bilinear_score(weight_vol: float = 0.5, weight_level: float = 0.5) -> Scoring:
    """Stress where the fundamentals are calm, less calm where the fundamentals are stressed; in [-1, 1]."""

    def score(p_vol: Column, p_level: Column, p_fund: Column) -> Column:
        stress = weight_vol * p_vol + weight_level * p_level
        raw = stress * (1 - p_fund) - (1 - stress) * p_fund
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))

    return score


def score_history(panel: DataFrame, window: int, least: int | None = None, scoring: Scoring | None = None, on: float = 0.6, off: float = 0.3, k: float = 0.1, cap: float = 1.0, min_sigma: float = 1e-8, size_only_when_active: bool = False) -> DataFrame:
    """panel (series_id, date, vol, level, fundamental, sigma) -> the same with ranks, the rows that their window held
    (n_obs_used), score, state, weight. Rows without all three ranks go; a sigma below `min_sigma` fails the query."""
    scoring = scoring or bilinear_score()
    ranks = {"p_vol": "vol", "p_level": "level", "p_fund": "fundamental"}
    ranked = rolling_ranks(panel, ranks, window, least, rows_used="n_obs_used").na.drop(subset=list(ranks))
    scored = hysteresis(ranked.withColumn("score", scoring(*[F.col(r) for r in ranks])), "score", on, off)
    sigma = F.when(F.col("sigma") >= min_sigma, F.col("sigma")).otherwise(F.raise_error(F.lit("sigma is too small to size a position")).cast("double"))
    weight = F.greatest(F.lit(-cap), F.least(F.lit(cap), k * F.col("score") / sigma))
    return scored.withColumn("weight", F.when(F.lit(not size_only_when_active) | F.col("active"), weight).otherwise(0.0))


def explain(history: DataFrame, date: str) -> DataFrame:
    """The last row up to `date`, one a series; a date beyond the sample fails the query."""
    last = history.groupBy("series_id").agg(F.max("date").alias("last_date"))
    history = require(history.join(last, "series_id"), F.col("last_date") >= F.lit(date).cast("date"), "the date is beyond the sample").drop("last_date")
    known = history.where(F.col("date") <= F.lit(date).cast("date"))
    newest = known.withColumn("newest", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))))
    return newest.where("newest = 1").drop("newest")


def decomposition(history: DataFrame, date: str, window: int, proxy: str, weight_vol: float = 0.5, weight_level: float = 0.5) -> DataFrame:
    """Everything a score on `date` is made of: the inputs, their ranks, stress and fundamental parts, state, weight,
    the rank window and how many rows it held."""
    return explain(history, date).select(
        "series_id", "date", "score", (weight_vol * F.col("p_vol") + weight_level * F.col("p_level")).alias("stress"), F.col("p_fund").alias("fundamental_rank"), "p_vol", "p_level", "p_fund",
        "vol", "sigma", "level", "fundamental", F.lit(proxy).alias("proxy"), "active", "weight", F.lit(window).alias("window"), "n_obs_used",
    )


def priced_returns(df: DataFrame, base_bps: float = 3.0, k: float = 1.5, multiplier: float | Column = 1.0, keys: list[str] | str = "series_id") -> DataFrame:
    """Yesterday's weight earns today's return; trading costs base + k * sigma / its median so far, on the
    change of weight. Adds held, cost and strat_ret."""
    by = over(keys)
    df = expanding_median(df, "sigma", "__median", keys)
    median = F.when(F.col("__median") > 0, F.col("__median")).otherwise(F.first("sigma").over(so_far(keys)))
    held = F.lag("weight", 1, 0.0).over(by)
    bps = base_bps + k * F.col("sigma") / median
    cost = multiplier * bps / 1e4 * F.abs(F.col("weight") - held)
    return df.withColumn("held", held).withColumn("cost", cost).withColumn("strat_ret", F.col("held") * F.col("ret") - F.col("cost")).drop("__median")


def cost_sensitivity(df: DataFrame, multipliers: tuple[float, ...] = (1.0, 2.0, 3.0), base_bps: float = 3.0, k: float = 1.5) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))
    spread = df.withColumn("multiplier", grid)
    return priced_returns(spread, base_bps, k, F.col("multiplier"), ["series_id", "multiplier"])


def economic_metrics(df: DataFrame, keys: list[str] | None = None, periods: int = 252, risk_free: float = 0.0, column: str = "strat_ret", weight: str = "weight") -> DataFrame:
    """Ten figures for each key. Ratios without a base are NULL; a payoff without losses is infinite."""
    keys = keys or ["series_id"]
    frame = so_far(keys)
    r, w = F.col(column), F.col(weight)
    path = df.where(r.isNotNull()).withColumn("log_equity", F.sum(F.ln(1 + r)).over(frame))
    path = path.withColumn("drawdown", F.exp(F.col("log_equity") - F.max("log_equity").over(frame)) - 1).withColumn("dw", F.abs(w - F.lag(w).over(over(keys))))
    under = F.col("drawdown") < -1e-12
    path = path.withColumn("resets", F.sum(F.when(under, 0).otherwise(1)).over(frame))
    path = path.withColumn("under_for", F.when(under, F.sum(F.when(under, 1).otherwise(0)).over(Window.partitionBy(*keys, "resets").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    a = path.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.ln(1 + r)).alias("total"), F.stddev_samp(r).alias("sd"), F.stddev_samp(F.when(r < 0, r)).alias("sd_down"), F.min("drawdown").alias("max_drawdown"),
        F.max("under_for").cast("long").alias("max_drawdown_duration"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg(F.when(r > 0, r)).alias("win"), F.avg(F.when(r < 0, r)).alias("loss"), F.sum("dw").alias("traded"),
    )
    years = F.col("n") / periods
    growth, vol, down = F.exp(F.col("total") / years) - 1, F.col("sd") * periods**0.5, F.col("sd_down") * periods**0.5
    return a.select(
        *keys,
        growth.alias("ann_return"),
        vol.alias("ann_vol"),
        F.when(vol > 0, (growth - risk_free) / vol).alias("sharpe"),
        F.when(down > 0, growth / down).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, growth / F.abs("max_drawdown")).alias("calmar"),
        "max_drawdown",
        "max_drawdown_duration",
        "hit_rate",
        F.when(F.col("loss").isNull(), F.when(F.col("win").isNotNull(), F.lit(float("inf")))).otherwise(F.coalesce(F.col("win") / F.abs("loss"), F.lit(0.0))).alias("payoff_ratio"),
        F.coalesce(F.col("traded") / years, F.lit(0.0)).alias("ann_turnover"),
    )


def quintiles(df: DataFrame, score: str, forward: str) -> DataFrame:
    """Mean and count of the forward value by score quintile; edges are exact percentiles, bins closed on the
    right, and every series has rows 1 to 5. Tied edges leave bins empty."""
    own = df.where(F.col(score).isNotNull() & F.col(forward).isNotNull())
    edges = own.groupBy("series_id").agg(F.percentile(score, F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).alias("edges"))
    binned = own.join(edges, "series_id").withColumn("quintile", 1 + F.size(F.filter("edges", lambda e: e < F.col(score))))
    counted = binned.groupBy("series_id", "quintile").agg(F.avg(forward).alias("mean"), F.count("*").alias("n"))
    every = edges.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("quintile"))
    return every.join(counted, ["series_id", "quintile"], "left").na.fill({"n": 0})


def worst_month(df: DataFrame, column: str = "ret") -> DataFrame:
    monthly = df.groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(F.sum(column).alias("total"))
    return monthly.groupBy("series_id").agg(F.min_by("month", F.struct("total", "month")).alias("month"), F.min("total").alias("total"))


def first_value_cv(df: DataFrame, column: str, limit: float = 0.15) -> DataFrame:
    """Coefficient of variation of each month's first value, and whether it is beyond `limit`."""
    monthly = df.groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(F.min_by(column, "date").alias("v"))
    out = monthly.groupBy("series_id").agg(F.try_divide(F.stddev_samp("v"), F.abs(F.avg("v"))).alias("cv"))
    return out.withColumn("unstable", F.col("cv") > limit)


def failure_flags(metrics: DataFrame, benchmarks: DataFrame, at_triple_cost: DataFrame, episodes: DataFrame, regression: DataFrame, by_quintile: DataFrame, least_episodes: int = 5) -> DataFrame:
    """Why a strategy shouldn't be run, one boolean a rule. Benchmarks are books, among them buy_hold and realised_vol;
    `by_quintile` (series_id, quintile, mean) are forward returns by score."""
    of = lambda book, column: F.max(F.when(F.col("book") == book, F.col(column)))
    best = benchmarks.agg(F.max(F.when(F.col("book") != "realised_vol", F.col("sharpe"))).alias("best_sharpe"), of("buy_hold", "ann_return").alias("held_return"), of("realised_vol", "sharpe").alias("moving_sharpe"))  # one row
    steps = by_quintile.where("mean IS NOT NULL").withColumn("step", F.col("mean") - F.lag("mean").over(over("series_id", "quintile")))
    steps = steps.groupBy("series_id").agg(F.coalesce(F.min("step") < 0, F.lit(False)).alias("falls"))
    joined = metrics.crossJoin(F.broadcast(best)).join(at_triple_cost.select("series_id", F.col("ann_return").alias("return_x3")), "series_id", "left")
    joined = joined.join(episodes.select("series_id", "n_episodes"), "series_id", "left").join(regression.select("series_id", "t_stat", "beta"), "series_id", "left").join(steps, "series_id", "left")
    return joined.select(
        "series_id",
        (F.col("sharpe") <= 0).alias("no_reward"),
        (F.col("sharpe") < F.col("best_sharpe")).alias("beaten_by_benchmark"),
        (F.col("return_x3") <= 0).alias("not_implementable"),
        (F.coalesce("n_episodes", F.lit(0)) < least_episodes).alias("too_few_episodes"),
        (F.coalesce(F.abs("t_stat"), F.lit(0.0)) < 1.96).alias("not_significant"),
        (F.coalesce("beta", F.lit(0.0)) <= 0).alias("wrong_sign"),
        (F.col("max_drawdown") < -0.5).alias("deep_drawdown"),
        (F.col("payoff_ratio") < 1).alias("poor_payoff"),
        F.coalesce("falls", F.lit(False)).alias("quintiles_not_monotone"),
        F.coalesce(F.col("moving_sharpe") >= F.col("sharpe"), F.lit(False)).alias("beaten_by_realised_vol"),
        F.coalesce(F.col("ann_return") < F.col("held_return"), F.lit(False)).alias("beaten_by_buy_hold"),
    )


def layer_comparison(layers: DataFrame, ids: list[str], artifact_below: float = 0.3) -> DataFrame:
    """Pairwise correlation of layers on common dates, its minimum, and whether that marks an artifact."""
    from ..functions.windows import safe_corr

    table = layers.groupBy("date").pivot("series_id", ids).agg(F.first("value")).na.drop()
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    out = table.agg(F.count("*").alias("n"), *[safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"{a}|{b}") for a, b in pairs])
    least = F.least(*[F.col(f"`{a}|{b}`") for a, b in pairs]) if len(pairs) > 1 else F.col(f"`{pairs[0][0]}|{pairs[0][1]}`")
    return out.withColumn("least_corr", least).withColumn("artifact", F.col("least_corr") < artifact_below)
