"""Window and column helpers. Series are long tables (series_id, date, value); every window is partitioned by
the series, so a panel of any number of series runs in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, DATE, VALUE = "series_id", "date", "value"


def over(keys: list[str] | str = KEY, order: str = DATE) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def last_rows(n: int, keys: list[str] | str = KEY, order: str = DATE) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return over(keys, order).rowsBetween(-(n - 1), 0)


def so_far(keys: list[str] | str = KEY, order: str = DATE) -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: list[str] | str = KEY, order: str = DATE) -> WindowSpec:
    return over(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def full(value: Column, frame: WindowSpec, result: Column, least: int) -> Column:
    """`result` where the frame holds `least` values or more."""
    return F.when(F.count(value).over(frame) >= least, result)


def island_ids(df: DataFrame, starts: Column, name: str = "island", keys: list[str] | str = KEY, order: str = DATE) -> DataFrame:
    """Number the runs of rows: a run begins where `starts` is true."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(so_far(keys, order)))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, NULL where a side is constant (corr() itself raises under ANSI)."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fail the query, with `message`, at the first row where `ok` isn't true."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
