"""Calendars and point-in-time joins.

Spark has no public as-of join. Here both sides are unioned under the key and the last value carries forward:
one shuffle on the key and one sort, no range join, so it holds at any size with as many keys as tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import over, require, so_far
from .scans import chunk_of


def slice_dates(series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Closed at both ends."""
    if start:
        series = series.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        series = series.where(F.col("date") <= F.lit(end).cast("date"))
    return series


def normalise_dates(df: DataFrame, column: str = "date", zone: str = "UTC", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Midnight dates in `zone`; a date that occurs twice within a series fails the query."""
    from pyspark.sql import Window

    dated = df.withColumn(column, F.to_date(F.from_utc_timestamp(F.col(column).cast("timestamp"), zone)))
    counted = dated.withColumn("times", F.count("*").over(Window.partitionBy(*keys, column)))
    return require(counted, F.col("times") == 1, "a date occurs twice").drop("times")


def publication_lag(series: DataFrame, days: int) -> DataFrame:
    if days < 0:
        raise ValueError("a publication lag can't be negative")
    return series.withColumn("date", F.date_add("date", days))


def publication_date(column: Column | str = "date", days: int = 45) -> Column:
    """Availability of a monthly value: the month's last day and `days` more."""
    return F.date_add(F.last_day(column), days)


def available_asof(series: DataFrame, asof: str, days: int = 45) -> DataFrame:
    return series.withColumn("publication_date", publication_date("date", days)).where(F.col("publication_date") <= F.lit(asof).cast("date"))


def reestimation_dates(calendar: DataFrame, least_before: int) -> DataFrame:
    """The first weekday of each month, if the calendar has it and `least_before` rows stand before it."""
    first = F.trunc("date", "MM")
    shift = F.when(F.dayofweek(first) == 7, 2).when(F.dayofweek(first) == 1, 1).otherwise(0)
    numbered = calendar.withColumn("before", F.row_number().over(over()) - 1)
    return numbered.where((F.col("date") == F.date_add(first, shift)) & (F.col("before") >= least_before))


def month_end_levels(series: DataFrame) -> DataFrame:
    """The last observation of each month, stamped at the calendar month's end."""
    grouped = series.groupBy("series_id", F.last_day("date").alias("month_end")).agg(F.max_by("value", "date").alias("value"))
    return grouped.select("series_id", F.col("month_end").alias("date"), "value")


def asof_join(left: DataFrame, right: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """For each row of `left`, the last row of `right` with a date up to its own; NULL before the first.
    On an equal date the right row is seen. Without keys the calendar is cut into months, which many tasks carry
    forward; each month begins with the last value of those before it."""
    if not keys:
        return _asof_by_month(left, right, values)
    carried = F.struct(*values).alias("carried")
    kept = [c for c in left.columns if c not in keys and c != "date"]
    none = F.lit(None).cast(right.select(carried).schema[0].dataType)
    rows = left.select(*keys, "date", F.lit(1).alias("side"), F.struct(F.lit(1).alias("__left"), *kept).alias("own"), none.alias("carried"))
    seen = right.select(*keys, "date", F.lit(0).alias("side"), F.lit(None).cast(rows.schema["own"].dataType).alias("own"), carried)
    from pyspark.sql import Window

    frame = Window.partitionBy(*keys).orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.unionByName(seen).withColumn("carried", F.last("carried", ignorenulls=True).over(frame)).where("side = 1")
    return joined.select(*keys, "date", *[F.col(f"own.{c}").alias(c) for c in kept], *[F.col(f"carried.{v}").alias(v) for v in values])


def _asof_by_month(left: DataFrame, right: DataFrame, values: list[str]) -> DataFrame:
    from pyspark.sql import Window

    month = F.trunc("date", "MM").alias("__month")
    inner = asof_join(left.select("*", month), right.select("date", month, F.struct(F.lit(1).alias("__seen"), *values).alias("__v")), ["__v"], ["__month"])
    # one row a month: what the month leaves to the next ones
    leaves = right.groupBy(month).agg(F.max_by(F.struct(*values), "date").alias("last"))
    months = leaves.unionByName(left.select(month).distinct(), allowMissingColumns=True).groupBy("__month").agg(F.max("last").alias("last"))
    earlier = Window.orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    start = months.select(F.col("__month").alias("__m"), F.last("last", ignorenulls=True).over(earlier).alias("__before"))
    joined = inner.join(start, F.col("__month") == F.col("__m"), "left")
    kept = [c for c in left.columns if c != "date"]
    return joined.select("date", *kept, *[F.when(F.col("__v.__seen").isNotNull(), F.col(f"__v.{v}")).otherwise(F.col(f"__before.{v}")).alias(v) for v in values])


def calendar_intersection(series: DataFrame, n_series: int | None = None) -> DataFrame:
    """Dates that all series have."""
    counted = series.groupBy("date").agg(F.count_distinct("series_id").alias("n"))
    if n_series is None:
        total = series.agg(F.count_distinct("series_id").alias("total"))
        return counted.join(F.broadcast(total), F.col("n") == F.col("total")).select("date")
    return counted.where(F.col("n") == n_series).select("date")


def union_fill(panel: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series_id",), keep: tuple[str, ...] = ()) -> DataFrame:
    """On a union calendar, each column's last value carried forward; rows before all have begun go. Columns to
    `keep` stay as they are."""
    filled = [F.last(c, ignorenulls=True).over(so_far(list(keys))).alias(c) for c in columns]
    return panel.select(*keys, "date", *keep, *filled).na.drop(subset=columns)


def align_union(series: DataFrame, ids: list[str], name: str = "panel") -> DataFrame:
    """Long series -> one row a date of the union calendar, one filled column a series; of values that share a date
    the least counts."""
    table = series.groupBy("date").pivot("series_id", ids).agg(F.min("value")).withColumn("series_id", F.lit(name))
    return union_fill(table, ids)


def aggregation_weights(daily: DataFrame) -> DataFrame:
    """Day-to-month band: each day weighs 1 / (days of its month)."""
    from pyspark.sql import Window

    month = F.trunc("date", "MM")
    return daily.withColumn("month", month).withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("series_id", "month")))


def replicated(daily: DataFrame, monthly: DataFrame, column: str = "value") -> DataFrame:
    """(series_id, month, replicated, target, error): monthly means of a daily path beside what they should be."""
    means = daily.groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(F.avg(column).alias("replicated"))
    target = monthly.select(F.trunc("date", "MM").alias("tm"), F.col("value").alias("target"))
    both = means.join(target, F.col("month") == F.col("tm"))
    return both.select("series_id", "month", "replicated", "target", F.abs(F.col("replicated") - F.col("target")).alias("error"))


def aggregation_error(daily: DataFrame, monthly: DataFrame, column: str = "value") -> DataFrame:
    return replicated(daily, monthly, column).groupBy("series_id").agg(F.count("*").alias("months"), F.max("error").alias("max_error"))


def common_months(high: DataFrame, low: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Days whose month the low-frequency series has, and months that have days."""
    m = F.trunc("date", "MM")
    h, lo = high.withColumn("month", m), low.withColumn("month", m)
    return h.join(lo.select("month").distinct(), "month", "left_semi"), lo.join(h.select("month").distinct(), "month", "left_semi")


def log_indicators(vix: DataFrame, level: DataFrame, slope: DataFrame) -> DataFrame:
    """ln of two strictly positive series and the slope as it is, on the first one's calendar."""
    a = require(vix.select("date", F.col("value").alias("v")), F.col("v") > 0, "must be positive").select("date", F.ln("v").alias("ln_vix"))
    b = require(level.select("date", F.col("value").alias("l")), F.col("l") > 0, "must be positive").select("date", F.ln("l").alias("ln_hy"))
    return a.join(b, "date", "left").join(slope.select("date", F.col("value").alias("slope")), "date", "left").na.drop()


def lag_sensitivity(daily: DataFrame, monthly: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, date, value, asof_value): what was published by each day under each lag."""
    spark = daily.sparkSession
    grid = F.broadcast(spark.createDataFrame([(int(x),) for x in lags], "lag int"))
    left = daily.select("date", "value").crossJoin(grid)
    right = monthly.select("date", F.col("value").alias("asof_value")).crossJoin(grid)
    right = right.select("lag", F.date_add(F.last_day("date"), F.col("lag")).alias("date"), "asof_value")
    return asof_join(left, right, ["asof_value"], keys=["lag"])


def interval_join(rows: DataFrame, intervals: DataFrame, at: str = "date", start: str = "start", end: str = "end", keys: list[str] | None = None, days: int = 64) -> DataFrame:
    """Every row with every interval that it lies in, both ends included; intervals may overlap and be any number. `keys`
    must agree too. Time is cut into bins of `days`, an interval stands in all that it touches, and the join is one on
    bins with an exact check after: a row meets only intervals of its bin. Rows without a time, intervals without an end
    and those that end before they start match nothing. A column of both sides that isn't a key keeps the rows' value."""
    keys = keys or []
    bin_of = lambda df, c: chunk_of(df, c, days)
    kept = [c for c in intervals.columns if c in keys or c not in rows.columns]
    spans = intervals.where(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(F.sequence(bin_of(intervals, start), bin_of(intervals, end))))
    bounds = [F.col(start).alias("__start"), F.col(end).alias("__end")]
    both = rows.withColumn("__bin", bin_of(rows, at)).join(spans.select(*kept, *bounds, "__bin"), [*keys, "__bin"])
    found = both.where((F.col(at) >= F.col("__start")) & (F.col(at) <= F.col("__end")))
    return found.select(*rows.columns, *[c for c in kept if c not in keys])


def in_episodes(df: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows within [start, end] of an episode, with the episode's columns."""
    return interval_join(df, episodes)
