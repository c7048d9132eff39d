"""Windows over a split series: blocks of rows, each with the rows before it that its windows reach.

Rows are numbered along their series without sorting it in one task: rows of a stretch of time are numbered there and the
counts of the stretches before are added. A block is `ROWS` rows, or a window's length if that is more; a row goes to
its own block and, if the next one's windows reach it, to that one too. So a row is shuffled twice at most, whatever the
window, and a task holds two windows at most.

Ranks and quantiles keep the window's values in a sorted list, which each row enters and leaves once. A quantile of all
values so far reaches back without end; there a block gets only those earlier values that its quantiles can become: see
`expanding_quantile`.

Defined cases: a missing value (null or NaN) isn't held and has no rank; rows that tie in date are taken in any order;
rows without a date come last; a null key is a series of its own; other columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from .scans import _LAST, chunk_of

ROWS = 4096
#: Buckets of values in the index of an expanding quantile.
BUCKETS = 256
_FINE = 16


def positioned(df: DataFrame, keys: list[str], order: str = "date", name: str = "__pos", sums: dict[str, str] | None = None) -> DataFrame:
    """Number the rows along each series, from 0; `sums`, {new column: column}, adds sums so far."""
    sums = sums or {}
    rows = df.withColumn("__key", F.struct(*keys)).withColumn("__stretch", F.coalesce(chunk_of(df, order), F.lit(_LAST)))
    before = Window.partitionBy("__key").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__key", "__stretch").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s{k}") for k, c in enumerate(sums.values())])
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__n", *(f"__s{k}" for k in range(len(sums))))]
    inside = Window.partitionBy("__key", "__stretch").orderBy(F.col(order).asc_nulls_last())
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("*", (F.row_number().over(inside) - 1).alias("__inside"), *[F.sum(c).over(so_far).alias(f"__c{k}") for k, c in enumerate(sums.values())])
    placed = placed.join(counts.select("__key", "__stretch", *earlier).hint("shuffle_hash"), ["__key", "__stretch"])
    totals = [(F.col(f"__s{k}_before") + F.col(f"__c{k}")).alias(c) for k, c in enumerate(sums)]
    return placed.select(*[c for c in df.columns if c not in sums], (F.col("__n_before") + F.col("__inside")).alias(name), *totals)


def _schema(df: DataFrame, outputs: str) -> str:
    new = {o.strip().split()[0] for o in outputs.split(",")}
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new), outputs])


def by_block(df: DataFrame, reach: int, compute: Callable[[pa.Table, int], list[pa.Array]], outputs: str, keys: list[str] | None = None, order: str = "date", rows: int = ROWS) -> DataFrame:
    """Add the columns of `outputs`: `compute` gets a block's rows in order, the first so many of them only as what the
    others' windows reach (up to `reach` rows back), and returns the columns for all of them."""
    keys = keys or ["series_id"]
    names = [o.strip().split()[0] for o in outputs.split(",")]
    kept = [c for c in df.columns if c not in names]
    size = max(rows, reach)
    block = F.floor(F.col("__pos") / size)
    reached = F.col("__pos") >= (block + 1) * size - reach
    dealt = positioned(df, keys, order).withColumn("__block", F.explode(F.when(reached, F.array(block, block + 1)).otherwise(F.array(block))))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["__pos"]))
        first = table["__block"][0].as_py() * size
        context = bisect_left(table["__pos"].to_numpy(), first)
        own = table.select(kept).slice(context)
        for name, column in zip(names, compute(table, context)):
            own = own.append_column(name, column.slice(context))
        return own

    return dealt.groupBy(*keys, "__block").applyInArrow(run, _schema(df, outputs))


def floats(table: pa.Table, column: str) -> np.ndarray:
    """A column as numbers, missing ones NaN."""
    return pc.cast(table[column], pa.float64()).to_numpy(zero_copy_only=False)


def window_ranks(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """The share of the last `window` rows' values up to each row's own; NaN where it is missing or fewer than `least`
    are held."""
    held: list[float] = []
    out = np.full(len(x), np.nan)
    values = x.tolist()
    for i, v in enumerate(values):
        if i >= window and (gone := values[i - window]) == gone:
            del held[bisect_left(held, gone)]
        if v == v:
            insort(held, v)
            if len(held) >= least:
                out[i] = bisect_right(held, v) / len(held)
    return out


def _at(held: list[float], share: float, n: int, skipped: int = 0) -> float:
    """The quantile of n values, linear between neighbours, of which `held` has those after the first `skipped`."""
    at = share * (n - 1)
    k = int(at)
    low = held[k - skipped]
    return low if k + 1 >= n else low + (at - k) * (held[k + 1 - skipped] - low)


def window_quantiles(x: np.ndarray, window: int, share: float) -> np.ndarray:
    """The quantile of the `window` rows before each row, where all of them have values."""
    held: list[float] = []
    out = np.full(len(x), np.nan)
    values = x.tolist()
    for i, v in enumerate(values):
        if len(held) == window:
            out[i] = _at(held, share, window)
        if i >= window and (gone := values[i - window]) == gone:
            del held[bisect_left(held, gone)]
        if v == v:
            insort(held, v)
    return out


def window_moments(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the `window` rows before each row, where all of them have values."""
    middle = np.nanmean(x) if np.isfinite(x).any() else 0.0
    y = np.where(np.isnan(x), 0.0, x - middle)
    whole, sums, squares = (np.concatenate([[0.0], np.cumsum(c)]) for c in (~np.isnan(x), y, y * y))
    i = np.arange(len(x))
    lo = np.maximum(i - window, 0)
    full = whole[i] - whole[lo] == window
    mean = (sums[i] - sums[lo]) / window
    var = np.maximum(squares[i] - squares[lo] - window * mean * mean, 0.0) / max(window - 1, 1)
    return np.where(full, mean + middle, np.nan), np.where(full & (window > 1), np.sqrt(var), np.nan)


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def rolling_ranks(
    df: DataFrame, ranks: dict[str, str], window: int, least: int | None = None, keys: list[str] | None = None, order: str = "date", rows: int = ROWS, rows_used: str | None = None
) -> DataFrame:
    """Causal percentile ranks, {new column: column}: the share of the values of the last `window` rows up to the current
    one; NULL where that is missing or fewer than `least` (else `window`) are held. `rows_used` names a column for how
    many rows the window has."""

    def compute(t: pa.Table, _: int) -> list[pa.Array]:
        found = [_numbers(window_ranks(floats(t, c), window, least or window)) for c in ranks.values()]
        return [*found, pa.array(np.minimum(t["__pos"].to_numpy() + 1, window), pa.int64())][: len(found) + (rows_used is not None)]

    return by_block(df, window - 1, compute, ", ".join([f"{n} double" for n in ranks] + [f"{rows_used} long"] * (rows_used is not None)), keys, order, rows)


def moving_quantile(df: DataFrame, column: str, window: int, share: float, name: str, keys: list[str] | None = None, order: str = "date", rows: int = ROWS) -> DataFrame:
    """The quantile, and `name`_mean and `name`_sd, of the previous `window` rows; NULL unless all of them have values."""

    def compute(t: pa.Table, _: int) -> list[pa.Array]:
        x = floats(t, column)
        return [_numbers(c) for c in (window_quantiles(x, window, share), *window_moments(x, window))]

    return by_block(df, window, compute, f"{name} double, {name}_mean double, {name}_sd double", keys, order, rows)


def expanding_quantile(
    df: DataFrame, column: str, share: float, name: str, keys: list[str] | str = "series_id", include_current: bool = True, least: int = 1, order: str = "date", rows: int = ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """The quantile (linear between neighbours) of all values so far, with or without the row's own; NULL before there are
    `least`.

    While a block's rows pass, the rank that the quantile has among the values before the block moves by no more than the
    block's rows. So a block needs only a slice of those values in order. An index of counts by (block, bucket of values)
    tells which buckets a block's slice lies in, and a join fetches their earlier values: some three times a block's rows,
    and what the bounds of the buckets add."""
    keys = [keys] if isinstance(keys, str) else keys
    kept = [c for c in df.columns if c != name]
    base = positioned(df.select(*kept), keys, order).withColumn("__key", F.struct(*keys)).withColumn("__block", F.floor(F.col("__pos") / rows))
    base = written(base)  # the index, the slices and the blocks are all made of it
    value = F.col(column).cast("double")
    points = base.select("__key", "__block", value.alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")

    cuts = points.groupBy("__key").agg(F.percentile_approx("__v", [k / buckets for k in range(1, buckets)], F.lit(16 * buckets)).alias("__cuts"))
    coarse = F.transform(F.sequence(F.lit(_FINE), F.lit(buckets - 1), F.lit(_FINE)), lambda k: F.element_at("__cuts", k))
    at = lambda c: F.size(F.filter(c, lambda x: x < F.col("__v")))
    fine = F.slice("__cuts", F.col("__c") * _FINE + 1, F.lit(_FINE))
    placed = points.join(cuts, "__key").withColumn("__c", at(coarse)).withColumn("__bucket", F.col("__c") * _FINE + at(fine)).select("__key", "__block", "__v", "__bucket")

    blocks = Window.partitionBy("__key").orderBy("__block")
    sizes = base.groupBy("__key", "__block").agg(F.count(F.when(value.isNotNull() & ~F.isnan(value), 1)).alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(blocks) - F.col("__n"))
    low = F.floor(share * (F.col("__before") - 1)) - F.col("__n") - 1
    high = F.floor(share * (F.col("__before") + F.col("__n"))) + 2
    cells = placed.groupBy("__key", "__block", "__bucket").agg(F.count("*").alias("__m"))
    grid = sizes.select("__key", "__block", low.alias("__low"), high.alias("__high"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("__bucket"))
    earlier = Window.partitionBy("__key", "__bucket").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("__key", "__block").orderBy("__bucket")
    index = (
        grid.join(cells, ["__key", "__block", "__bucket"], "left")
        .withColumn("__m", F.coalesce(F.sum("__m").over(earlier), F.lit(0)))
        .withColumn("__below", F.sum("__m").over(up_to) - F.col("__m"))
        .where((F.col("__m") > 0) & (F.col("__below") + F.col("__m") > F.col("__low")) & (F.col("__below") <= F.col("__high")))
    )
    wanted = index.select("__key", F.col("__block").alias("__for"), "__bucket", "__below")
    slices = wanted.join(placed, ["__key", "__bucket"]).where(F.col("__block") < F.col("__for")).select(*[F.col("__key")[k].alias(k) for k in keys], F.col("__for").alias("__block"), "__v", "__below")
    own = base.join(sizes.select("__key", "__block", "__before").hint("shuffle_hash"), ["__key", "__block"]).drop("__key")

    def run(own: pa.Table, before: pa.Table) -> pa.Table:
        own = own.take(pc.sort_indices(own["__pos"]))
        held = np.sort(before["__v"].to_numpy()).tolist()
        skipped = pc.min(before["__below"]).as_py() or 0
        n = own["__before"][0].as_py() if own.num_rows else 0
        out = []
        for x in floats(own, column).tolist():
            if not include_current:
                out.append(_at(held, share, n, skipped) if n >= max(1, least) else None)
            if x == x:
                if held and skipped and x < held[0]:
                    skipped += 1
                elif not held or skipped + len(held) == n or x <= held[-1]:  # else it is beyond the slice
                    insort(held, x)
                n += 1
            if include_current:
                out.append(_at(held, share, n, skipped) if n >= max(1, least) else None)
        return own.select(kept).append_column(name, pa.array(out, pa.float64()))

    return own.groupBy(*keys, "__block").cogroup(slices.groupBy(*keys, "__block")).applyInArrow(run, _schema(df, f"{name} double"))
