"""VaR and ES: hits, formal backtests, overlay of exposures."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.windows import over, require
from .calendar import interval_join
from .folds import smooth_and_hold
from .stats import least_squares


def hits(df: DataFrame, var: str = "var", ret: str = "ret") -> DataFrame:
    """1 where the loss is beyond the VaR, over rows that have both; a negative VaR fails the query."""
    both = df.where(F.col(var).isNotNull() & F.col(ret).isNotNull())
    beyond = F.when(F.col(var) >= 0, F.col(ret) < -F.col(var)).otherwise(F.raise_error(F.lit("a VaR is negative")).cast("boolean"))
    return both.withColumn("hit", beyond.cast("int"))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.ln(y)).otherwise(0.0)


def kupiec(hit: DataFrame, p: float, keys: list[str] | None = None) -> DataFrame:
    """Likelihood ratio of the hit rate against p."""
    keys = keys or ["series_id"]
    a = hit.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("x"))
    n, x = F.col("n"), F.col("x")
    null = (n - x) * math.log(1 - p) + x * math.log(p)
    free = _xlogy(n - x, 1 - x / n) + _xlogy(x, x / n)
    lr = -2 * (null - free)
    return a.withColumn("hit_rate", x / n).withColumn("lr_uc", F.when(F.abs(lr) < 1e-12, 0.0).otherwise(lr))


def transition_counts(hit: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["series_id"]
    lagged = hit.withColumn("prev", F.lag("hit").over(over(keys))).where("prev IS NOT NULL")
    return lagged.groupBy(*keys).agg(*[F.count_if((F.col("prev") == i) & (F.col("hit") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])


def christoffersen(hit: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Independence of hits: one hit probability against one for each state before; 0 where a state has no row."""
    c = transition_counts(hit, keys)
    n00, n01, n10, n11 = (F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1))
    pooled = (n01 + n11) / (n00 + n01 + n10 + n11)
    null = _xlogy(n00 + n10, 1 - pooled) + _xlogy(n01 + n11, pooled)
    free = _xlogy(n00, n00 / (n00 + n01)) + _xlogy(n01, n01 / (n00 + n01)) + _xlogy(n10, n10 / (n10 + n11)) + _xlogy(n11, n11 / (n10 + n11))
    lr = F.when((n00 + n01 == 0) | (n10 + n11 == 0), 0.0).otherwise(-2 * (null - free))
    return c.withColumn("lr_ind", F.when(F.abs(lr) < 1e-12, 0.0).otherwise(lr))


def conditional_coverage(hit: DataFrame, p: float, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["series_id"]
    both = kupiec(hit, p, keys).join(christoffersen(hit, keys), keys)
    lr = F.col("lr_uc") + F.col("lr_ind")
    return both.withColumn("lr_cc", lr).withColumn("p_cc", F.exp(-lr / 2))


def basel_zone(exceptions: Column) -> Column:
    return F.when(exceptions <= 4, "green").when(exceptions <= 9, "yellow").otherwise("red")


def acerbi(hit: DataFrame, p: float, es: str = "es", ret: str = "ret", keys: list[str] | None = None) -> DataFrame:
    """Z1: mean relative exceedance of the hits, plus 1. Z2: their sum over n p, plus 1."""
    relative = F.col(ret) / F.col(es)
    return hit.where(F.col(es).isNotNull()).groupBy(*(keys or ["series_id"])).agg(
        (F.avg(F.when(F.col("hit") == 1, relative)) + 1).alias("z1"), (F.sum(relative * F.col("hit")) / (F.count("*") * p) + 1).alias("z2")
    )


def acerbi_null(n: int, p: float, draws: int, seed: int, spark, chunk: int = 500) -> DataFrame:
    """(z1, z2) under the null, simulated in seeded chunks: hits with probability p, exponential excesses."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                size = min(chunk, draws - int(k) * chunk)
                on = rng.random((size, n)) < p
                x = np.where(on, -rng.exponential(1.0, (size, n)), 0.0)
                count = on.sum(axis=1)
                yield pd.DataFrame({"z1": np.divide(x.sum(axis=1), count, out=np.zeros(size), where=count > 0) + 1, "z2": x.sum(axis=1) / (n * p) + 1})

    return spark.range(-(-draws // chunk)).mapInPandas(run, "z1 double, z2 double")


def dynamic_quantile(hit: DataFrame, p: float, lags: int = 4, var: str = "var") -> DataFrame:
    """Wald test that hits are unpredictable from a constant, the VaR and their own lags."""
    h = F.col("hit") - F.lit(float(p))
    names = [f"h{k}" for k in range(1, lags + 1)]
    rows = hit.select("series_id", h.alias("h"), F.lit(1.0).alias("one"), F.col(var).alias("v"), *[F.lag(h, k).over(over()).alias(n) for k, n in enumerate(names, 1)])
    df = lags + 2

    def wald(n: int, beta: np.ndarray, explained: float, residual: float, total: float) -> tuple | None:
        if n <= df:
            return None
        stat = explained / (residual / (n - df)) if residual > 0 else math.inf
        return stat, dist.chi2_sf(stat, df), df

    return least_squares(rows, "h", ["one", "v", *names], wald, "dq double, p_value double, df int")


def state_transitions(states: DataFrame, state: str = "state", order: str = "date", key: str = "series_id") -> DataFrame:
    """(key, from_state, to_state, n, p) of any number of states: how often a row's state follows another's, and its share
    of what follows that one. Pairs that don't occur have no row; missing states are skipped."""
    by = Window.partitionBy(key).orderBy(order)
    known = states.where(F.col(state).isNotNull()).select(key, F.lag(state).over(by).alias("from_state"), F.col(state).alias("to_state"))
    counts = known.where("from_state IS NOT NULL").groupBy(key, "from_state", "to_state").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key, "from_state")))


def backtest_suite(models: DataFrame, p: float, window: int = 250, significance: float = 0.05) -> DataFrame:
    """models (model, date, ret, var, es): every test for each model on all rows and on the last `window`,
    with a verdict a row and the worst of all."""
    base = models.where("ret IS NOT NULL AND var IS NOT NULL AND es IS NOT NULL")
    newest = base.withColumn("from_end", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("date"))))
    full = newest.withColumn("window", F.lit("full"))
    both = hits(full.unionByName(newest.where(F.col("from_end") <= window).withColumn("window", F.lit("rolling"))).drop("from_end"))
    keys = ["model", "window"]
    cc, z = conditional_coverage(both, p, keys), acerbi(both, p, keys=keys)
    reject = (F.col("lr_uc") > 3.841458820694124) | (F.col("p_cc") < significance) | (basel_zone(F.col("x")) == "red")
    out = cc.join(z, keys).withColumn("basel", basel_zone(F.col("x")))
    out = out.withColumn("verdict", F.when(reject, "reject").when(F.col("basel") == "yellow", "scrutiny").otherwise("pass"))
    worst = F.max(F.when(F.col("verdict") == "reject", 2).when(F.col("verdict") == "scrutiny", 1).otherwise(0)).over(Window.partitionBy())
    return out.withColumn("worst_verdict", F.element_at(F.array(F.lit("pass"), F.lit("scrutiny"), F.lit("reject")), worst + 1))


# --- overlay -----------------------------------------------------------------------------------------

BOOKS = ("base", "vol_only", "full_ms", "full_legacy", "conjunction")


def annualised(df: DataFrame, column: str, periods: int = 252, name: str = "sigma_ann") -> DataFrame:
    """A daily deviation in annual units; one that isn't positive fails the query."""
    return require(df, F.col(column) > 0, "a daily sigma must be positive").withColumn(name, F.col(column) * math.sqrt(periods))


def stress_of_states(df: DataFrame, column: str = "state", stress: tuple[int, ...] = (2, 3), name: str = "legacy") -> DataFrame:
    """A regime model's numbered states as a stress flag."""
    return df.withColumn(name, F.col(column).isin(list(stress)))


def overlay_inputs(sigma: DataFrame, es: DataFrame, states: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """(series_id, date, sigma_ann, es, stressed, confirms, legacy) on the common dates. Values that are missing or not
    positive there fail the query; without a legacy series nothing is in legacy stress, with a warning."""
    both = sigma.select("series_id", "date", "sigma_ann").join(es.select("series_id", "date", "es"), ["series_id", "date"])
    both = both.join(states.select("date", "stressed", "confirms"), "date")
    fine = F.col("sigma_ann").isNotNull() & F.col("es").isNotNull() & F.col("stressed").isNotNull() & F.col("confirms").isNotNull() & ~F.isnan("sigma_ann") & ~F.isnan("es")
    # one condition on columns of all sides, so that none of it moves below the joins and the first fault is named
    fault = F.when(~F.coalesce(fine, F.lit(False)), "an overlay input is missing").when(~((F.col("sigma_ann") > 0) & (F.col("es") > 0)), "sigma and ES must be positive")
    both = both.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))
    if legacy is None:
        warnings.warn("no legacy regime series: it counts as never in stress", stacklevel=2)
        return both.withColumn("legacy", F.lit(False))
    joined = both.join(legacy.select("date", "legacy"), "date", "left")
    return require(joined, F.col("legacy").isNotNull(), "the legacy series lacks a date")


def multipliers(df: DataFrame, target_vol: Column | float = 0.10, target_es: float = 0.025, kappa: Column | float = 0.5, cap: float = 1.0) -> DataFrame:
    """df (sigma_ann, es, stressed, confirms, legacy) -> m_vol, m_es and the regime multipliers. Stress
    without exogenous confirmation cuts half as much; the legacy flag knows no half cut."""
    k = kappa if isinstance(kappa, Column) else F.lit(float(kappa))
    tv = target_vol if isinstance(target_vol, Column) else F.lit(float(target_vol))
    legacy = F.coalesce(F.col("legacy"), F.lit(False))
    one = F.lit(1.0)
    return (
        df.withColumn("m_vol", F.least(F.lit(cap), tv / F.col("sigma_ann")))
        .withColumn("m_es", F.least(one, target_es / F.col("es")))
        .withColumn("m_regime", F.when(~F.col("stressed"), one).when(F.col("confirms"), k).otherwise(1 - (1 - k) / 2))
        .withColumn("m_legacy", F.when(legacy, k).otherwise(one))
        .withColumn("m_both", F.when(legacy & F.col("stressed"), k).otherwise(one))
    )


def books(df: DataFrame, alpha: float = 0.3, band: Column | float = 0.05, cap: float = 1.0, m_min: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """One row a book and date: the smallest of its parts, clipped, smoothed, executed beyond the band."""
    keys = keys or ["series_id"]
    full = F.least("m_vol", "m_es")
    parts = {"base": F.lit(1.0), "vol_only": F.col("m_vol"), "full_ms": F.least(full, "m_regime"), "full_legacy": F.least(full, "m_legacy"), "conjunction": F.least(full, "m_both")}
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("book"), F.greatest(F.lit(m_min), F.least(F.lit(cap), parts[b])).alias("raw")) for b in BOOKS]))
    stacked = df.select("*", rows.alias("b")).select("*", "b.book", "b.raw").drop("b")
    return smooth_and_hold(stacked, "raw", alpha, band, [*keys, "book"])


def binding(df: DataFrame) -> DataFrame:
    """Which constraint sets the full book's multiplier: one name, "tie", or "clip" if none equals it."""
    raw = F.least("m_vol", "m_es", "m_regime")
    on = [F.abs(F.col(c) - raw) <= 1e-12 for c in ("m_vol", "m_es", "m_regime")]
    count = sum((c.cast("int") for c in on), F.lit(0))
    name = F.when(count > 1, "tie").when(on[0], "vol").when(on[1], "es").when(on[2], "regime").otherwise("clip")
    return df.withColumn("m_raw", raw).withColumn("binding", name)


def multiplier_at(executed: DataFrame, date: str, book: str = "full_ms") -> DataFrame:
    """(series_id, multiplier) of a book on a date; a date that isn't in the sample fails the query."""
    day = F.lit(date).cast("date")
    per = executed.where(F.col("book") == book).groupBy("series_id").agg(F.max(F.when(F.col("date") == day, F.col("executed"))).alias("multiplier"))
    return require(per, F.col("multiplier").isNotNull(), "the date is not in the overlay's sample")


def scaled_weights(weights: dict[str, float], executed: DataFrame, date: str, book: str = "full_ms") -> DataFrame:
    """(series_id, asset, weight) of a fully invested portfolio scaled on a date; the rest is cash."""
    if "cash" in weights:
        raise ValueError("cash is what the overlay adds")
    if abs(sum(weights.values()) - 1) > 1e-8:
        raise ValueError("weights must sum to 1")
    m = F.col("multiplier")
    parts = [F.struct(F.lit(a).alias("asset"), (F.lit(float(w)) * m).alias("weight")) for a, w in weights.items()] + [F.struct(F.lit("cash").alias("asset"), (1 - m).alias("weight"))]
    return multiplier_at(executed, date, book).select("series_id", F.explode(F.array(*parts)).alias("e")).select("series_id", "e.asset", "e.weight")


def overlay_metrics(executed: DataFrame, alarm: float = 2.0) -> DataFrame:
    """Performance of each book (multiplier times return), its turnover beyond the base book's, and whether that is
    too much."""
    from .signals import economic_metrics

    per = economic_metrics(executed.withColumn("pnl", F.col("executed") * F.col("ret")), ["series_id", "book"], column="pnl", weight="executed")
    base = F.max(F.when(F.col("book") == "base", F.col("ann_turnover"))).over(Window.partitionBy("series_id"))
    extra = F.col("ann_turnover") - base
    return per.withColumn("incremental_turnover", extra).withColumn("turnover_alarm", extra > alarm)


def detection_lags(states: DataFrame, p: str = "p_stress", enter: float = 0.7) -> DataFrame:
    """(series_id, date, lag): for each declared stress episode, how many rows before it the probability had gone
    above `enter` for good."""
    above = F.coalesce(F.col(p) > enter, F.lit(False))
    began = F.col("stressed") & ~F.coalesce(F.lag("stressed").over(over()), F.lit(False))
    marked = states.withColumn("i", F.row_number().over(over())).withColumn("began", began)
    frame = over().rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("below", F.max(F.when(~above, F.col("i"))).over(frame))
    lag = F.when(above, F.col("i") - F.coalesce("below", F.lit(0)) - 1).otherwise(F.lit(-1))
    return marked.where("began").select("series_id", "date", lag.alias("lag"))


def regime_concordance(states: DataFrame, a: str = "ms", b: str = "legacy") -> DataFrame:
    """Share of days on which two regime flags agree, and how many differ each way."""
    x, y = F.col(a), F.col(b)
    return states.groupBy("series_id").agg(F.avg((x == y).cast("double")).alias("concordance"), F.count_if(x & ~y).alias("only_first"), F.count_if(~x & y).alias("only_second"), F.count("*").alias("n"))


def episode_leads(states: DataFrame, episodes: DataFrame, a: str = "ms", b: str = "legacy") -> DataFrame:
    """For each episode the first day of either flag and the lead of the first one, in rows."""
    numbered = states.withColumn("i", F.row_number().over(over()))
    own = interval_join(numbered, episodes)
    out = own.groupBy("episode").agg(F.min(F.when(F.col(a), F.col("i"))).alias("ia"), F.min(F.when(F.col(b), F.col("i"))).alias("ib"), F.min(F.when(F.col(a), F.col("date"))).alias("first_a"), F.min(F.when(F.col(b), F.col("date"))).alias("first_b"))
    return out.select("episode", "first_a", "first_b", (F.col("ib") - F.col("ia")).alias("lead_rows"), F.when(F.col("ia") < F.col("ib"), a).when(F.col("ib") < F.col("ia"), b).alias("leader"))


def transition_stats(states: DataFrame, periods: int = 252, alarm: float = 8.0, round_trip_bps: float = 10.0, partial: float = 0.5) -> DataFrame:
    """states (stressed, derisk): transitions a year, friction, episodes and their mean length, days derisked."""
    moved = F.coalesce((F.col("stressed") != F.lag("stressed").over(over())).cast("int"), F.lit(0))
    began = F.col("stressed") & ~F.coalesce(F.lag("stressed").over(over()), F.lit(False))
    marked = states.withColumn("moved", moved).withColumn("began", began.cast("int"))
    a = marked.groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum("moved").alias("n_transitions"), F.sum("began").alias("n_episodes"), F.count_if("stressed").alias("stress_days"),
        F.count_if(F.abs(F.col("derisk") - partial) < 1e-9).alias("partial_days"), F.count_if(F.abs(F.col("derisk") - 1) < 1e-9).alias("full_days"),
    )
    rate = F.col("n_transitions") / (F.col("n") / periods)
    return a.select(
        "series_id", "n", "n_transitions", rate.alias("per_year"), (rate > alarm).alias("alarm"), (rate * round_trip_bps).alias("friction_bps"), "n_episodes",
        F.when(F.col("n_episodes") > 0, F.col("stress_days") / F.col("n_episodes")).otherwise(0.0).alias("mean_duration"), "partial_days", "full_days",
    )


def transition_matrix(states: DataFrame) -> DataFrame:
    """Empirical probabilities of staying; a state without rows is absorbing."""
    pairs = states.withColumn("prev", F.lag("stressed").over(over())).where("prev IS NOT NULL")
    c = pairs.groupBy("series_id").agg(*[F.count_if((F.col("prev") == F.lit(i)) & (F.col("stressed") == F.lit(i))).alias(f"stay{int(i)}") for i in (False, True)], *[F.count_if(F.col("prev") == F.lit(i)).alias(f"from{int(i)}") for i in (False, True)])
    stay = [F.when(F.col(f"from{i}") > 0, F.col(f"stay{i}") / F.col(f"from{i}")).otherwise(1.0) for i in (0, 1)]
    out = c.select("series_id", stay[0].alias("p00"), stay[1].alias("p11"))
    return out.select("*", F.try_divide(F.lit(1.0), 1 - F.col("p00")).alias("calm_duration"), F.try_divide(F.lit(1.0), 1 - F.col("p11")).alias("stress_duration"), F.try_divide(1 - F.col("p00"), 2 - F.col("p00") - F.col("p11")).alias("stationary_stress"))
