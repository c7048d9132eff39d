"""Data-quality screens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import over, require, so_far
from .returns import changes, observed, simple_returns



def coverage(series: DataFrame, requested_start: str) -> DataFrame:
    """One row a series: span, counts, share of missing values, gap to the requested start."""
    missing = F.col("value").isNull() | F.isnan("value")
    return series.groupBy("series_id").agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count("*").alias("n_raw"),
        F.count_if(~missing).alias("n_obs"),
        F.count_if(missing).alias("n_nan"),
        (100.0 * F.count_if(missing) / F.count("*")).alias("pct_nan"),
        F.greatest(F.lit(0), F.datediff(F.min("date"), F.lit(requested_start).cast("date"))).alias("history_gap_days"),
    )


def reversing_jumps(series: DataFrame, kappa: float = 8.0, delta: float = 0.2) -> DataFrame:
    """Hampel screen: a change beyond kappa robust deviations that the next one takes back. Where the
    median change is zero, any non-zero change that reverses is one."""
    d = changes(series).withColumn("next", F.lead("change").over(over())).withColumn("n", F.row_number().over(over()))
    mad = d.where("change IS NOT NULL").groupBy("series_id").agg(F.median("change").alias("mid"))
    spread = d.join(mad, "series_id").where("change IS NOT NULL").groupBy("series_id").agg((1.4826 * F.median(F.abs(F.col("change") - F.col("mid")))).alias("sigma"))
    size = F.abs("change")
    beyond = F.when(F.col("sigma") > 0, size > kappa * F.col("sigma")).otherwise(size > 0)
    return d.join(spread, "series_id").where(beyond & F.col("next").isNotNull() & (F.abs(F.col("change") + F.col("next")) <= delta * size)).select("series_id", "date", "change", "next")


def validate(series: DataFrame, least: int, non_negative: bool = True, kappa: float = 8.0, delta: float = 0.2) -> DataFrame:
    """One row a series: its issues, joined by "; " (empty: none)."""
    per = series.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("n_dates"), F.count_if(F.col("value") < 0).alias("n_negative"), F.count("value").alias("n_obs")
    )
    jumps = reversing_jumps(series, kappa, delta).groupBy("series_id").agg(F.count("*").alias("n_jumps"))
    found = per.join(jumps, "series_id", "left").na.fill({"n_jumps": 0})
    issues = F.array_compact(
        F.array(
            F.when(F.col("n_dates") < F.col("n"), F.lit("duplicate dates")),
            F.when(F.col("n_obs") < least, F.lit("too short")),
            F.when(F.lit(non_negative) & (F.col("n_negative") > 0), F.lit("negative values")),
            F.when(F.col("n_jumps") > 0, F.lit("reversing jumps")),
        )
    )
    return found.select("series_id", "n_obs", "n_jumps", F.concat_ws("; ", issues).alias("issues"))


def require_valid(series: DataFrame, least: int, non_negative: bool = True, kappa: float = 8.0, delta: float = 0.2) -> DataFrame:
    """The series as they are; one with any issue fails the query, which names them."""
    issues = validate(series, least, non_negative, kappa, delta).select("series_id", "issues")
    joined = series.join(issues, "series_id")
    fault = F.concat(F.col("series_id"), F.lit(": "), F.col("issues"))
    return joined.where(F.when(F.col("issues") == "", F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))).drop("issues")


def runs_of(df: DataFrame, condition) -> DataFrame:
    """Adds `run`, the length of the run of rows for which `condition` holds, 0 elsewhere, and `place` in it."""
    starts = condition & ~F.coalesce(F.lag(condition).over(over()), F.lit(False))
    marked = df.withColumn("hold", condition).withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(so_far()))
    own = Window.partitionBy("series_id", "island", "hold")
    return marked.withColumn("run", F.when(F.col("hold"), F.count("*").over(own)).otherwise(0)).withColumn("place", F.row_number().over(own.orderBy("date")))


def longest_zero_run(series: DataFrame) -> DataFrame:
    d = changes(series).where("change IS NOT NULL")
    run = runs_of(d, F.col("change") == 0)
    return run.groupBy("series_id").agg(F.max("run").cast("long").alias("longest"), F.avg((F.col("change") == 0).cast("double")).alias("zero_share"), F.count("*").alias("n"))


def zero_run_bound(series: DataFrame, k: float = 3.0, floor: int = 2, least_share: float = 0.05) -> DataFrame:
    """Longest zero run against the bound expected of independent changes (Schilling)."""
    p = F.col("zero_share")
    expected = F.ln(F.col("n") * (1 - p)) / F.ln(1 / p)
    spread = F.sqrt(F.lit(math.pi**2) / (6 * F.pow(F.ln(1 / p), 2)) + 1 / 12)
    bound = F.when((p >= least_share) & (p < 1), F.greatest(F.lit(floor), F.ceil(expected + k * spread).cast("int"))).otherwise(F.lit(floor))
    return longest_zero_run(series).withColumn("bound", bound.cast("long")).withColumn("stale", F.col("longest") > F.col("bound"))


def require_no_stale_zeros(series: DataFrame, longest: int | None = None) -> DataFrame:
    """The series as they are; one whose longest run of unchanged values is beyond `longest` (else beyond what
    independent changes would give) fails the query."""
    found = zero_run_bound(series)
    bound = F.lit(longest) if longest is not None else F.col("bound")
    checked = found.withColumn("fine", F.col("longest") <= bound).select("series_id", "fine")
    return require(series.join(checked, "series_id", "left"), F.coalesce("fine", F.lit(True)), "a run of unchanged values is too long").drop("fine")


def mask_stale(prices: DataFrame, tolerance: float = 0.0, longest: int = 2) -> DataFrame:
    """Runs of unchanged prices longer than `longest` become NULL but for the first print."""
    d = changes(prices)
    run = runs_of(d, F.coalesce(F.abs("change") <= tolerance, F.lit(False)))
    masked = F.col("hold") & (F.col("run") > longest)
    return run.select("series_id", "date", F.when(~masked, F.col("value")).alias("value"), masked.alias("masked"))


def coupon_drops(prices: DataFrame, low: float = -0.006, high: float = -0.003, per_year: float = 8.0, gap: tuple[int, int] = (15, 35), unspaced: int = 2) -> DataFrame:
    """Unadjusted coupon payments: enough drops a year of a coupon's size, about a month apart."""
    r = simple_returns(prices).where("ret IS NOT NULL")
    years = r.groupBy("series_id").agg((F.count("*") / 252.0).alias("years"))
    hits = r.where(F.col("ret").between(low, high)).withColumn("gap", F.datediff("date", F.lag("date").over(over())))
    per = hits.groupBy("series_id").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("gap").between(*gap)).alias("n_monthly"))
    out = years.join(per, "series_id", "left").na.fill(0, ["n_candidates", "n_monthly"])
    flagged = (F.col("n_candidates") >= per_year * F.col("years")) & (F.col("n_monthly") >= F.col("n_candidates") - unspaced) & (F.col("n_candidates") > 0)
    return out.withColumn("flagged", flagged)


def history_gap(series: DataFrame, requested_start: str) -> DataFrame:
    return observed(series).groupBy("series_id").agg(F.datediff(F.min("date"), F.lit(requested_start).cast("date")).alias("gap_days"))


def check_lag(days: int, weekly: bool = False, weekday: int | None = None) -> None:
    """A weekly series needs a lag of a day at least, and a weekday to be stamped on."""
    if days < 0 or weekly and (days < 1 or weekday is None):
        raise ValueError("this publication lag would look ahead")
