"""Differences and returns, on the observed rows of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import last_rows, over, require, so_far



def observed(series: DataFrame) -> DataFrame:
    """Rows with a value; NaN counts as none."""
    return series.where(F.col("value").isNotNull() & ~F.isnan("value"))


def changes(series: DataFrame) -> DataFrame:
    """First difference between consecutive observed rows."""
    return observed(series).withColumn("change", F.col("value") - F.lag("value").over(over()))


def stress_returns(series: DataFrame) -> DataFrame:
    """-100 times the log change of a strictly positive level: positive when the level tightens."""
    positive = require(observed(series), F.col("value") > 0, "levels must be positive")
    return positive.withColumn("ret", -100 * (F.ln("value") - F.lag(F.ln("value")).over(over())))


def level_stress_returns(series: DataFrame) -> DataFrame:
    """The negative change, for levels that may be negative."""
    return observed(series).withColumn("ret", -(F.col("value") - F.lag("value").over(over())))


def simple_returns(series: DataFrame) -> DataFrame:
    return observed(series).withColumn("ret", F.col("value") / F.lag("value").over(over()) - 1)


def scaled_log_returns(series: DataFrame, scale: float = 0.01) -> DataFrame:
    """Log changes in the range of daily returns."""
    return observed(series).withColumn("ret", scale * F.ln(F.col("value") / F.lag("value").over(over()))).where("ret IS NOT NULL")


def forward_returns(returns: DataFrame, horizon: int, name: str | None = None) -> DataFrame:
    """Compounded over the next `horizon` rows, without the current one; NULL where they don't exist."""
    frame = over().rowsBetween(1, horizon)
    grown = F.exp(F.sum(F.ln(1 + F.col("ret"))).over(frame)) - 1
    return returns.withColumn(name or f"fwd_{horizon}", F.when(F.count("ret").over(frame) == horizon, grown))


def log_realised_variance(returns: DataFrame, window: int) -> DataFrame:
    frame = last_rows(window)
    total = F.sum(F.col("ret") * F.col("ret")).over(frame)
    return returns.withColumn("log_rv", F.when((F.count("ret").over(frame) == window) & (total > 0), F.ln(total)))


def standardised_residuals(residuals: DataFrame) -> DataFrame:
    """eps / sigma, rescaled to unit sample standard deviation within the series."""
    from pyspark.sql import Window

    z = F.col("eps") / F.col("sigma")
    return residuals.withColumn("z", z / F.stddev_samp(z).over(Window.partitionBy("series_id")))


def equity(returns: DataFrame, keys: list[str] | str = "series_id") -> DataFrame:
    """Compounded equity, its running maximum and the drawdown from it."""
    frame = so_far(keys)
    grown = returns.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(frame)))
    return grown.withColumn("peak", F.max("equity").over(frame)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def portfolio_returns(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum by date, over the dates on which every asset has a return."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    own = returns.where(F.col("series_id").isin(list(weights)) & F.col("ret").isNotNull())
    grouped = own.groupBy("date").agg(F.sum(F.col("ret") * F.element_at(w, F.col("series_id"))).alias("ret"), F.count("*").alias("n"))
    return grouped.where(F.col("n") == len(weights)).select(F.lit("portfolio").alias("series_id"), "date", "ret")
