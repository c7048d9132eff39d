"""Rolling and expanding windows, causal throughout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import norm_ppf
from ..functions.lineage import written
from ..functions.windows import full, last_rows, over, so_far
from .blocks import ROWS, by_block, expanding_quantile, floats, moving_quantile, positioned, rolling_ranks


def percentile_rank(series: DataFrame, window: int, least: int | None = None, column: str = "value", name: str = "rank") -> DataFrame:
    return rolling_ranks(series, {name: column}, window, least)


def exogenous_confirm(series: DataFrame, window: int, least: int, quantile: float, column: str = "value") -> DataFrame:
    """True where the causal rank reaches `quantile`; false where the window is short or constant."""
    frame = last_rows(window)
    moved = F.max(column).over(frame) - F.min(column).over(frame) >= 1e-15
    ranked = rolling_ranks(series, {"__rank": column}, window, least)
    return ranked.withColumn("confirms", F.coalesce(moved & (F.col("__rank") >= quantile), F.lit(False))).drop("__rank")


def rolling_std(series: DataFrame, window: int, column: str, name: str = "sigma", least: int | None = None) -> DataFrame:
    frame = last_rows(window)
    return series.withColumn(name, full(F.col(column), frame, F.stddev_samp(column).over(frame), least or window))


def rolling_sum(series: DataFrame, window: int, column: str, name: str, least: int | None = None) -> DataFrame:
    frame = last_rows(window)
    return series.withColumn(name, full(F.col(column), frame, F.sum(column).over(frame), least or window))


def expanding_median(series: DataFrame, column: str, name: str = "median", keys: list[str] | str = "series_id") -> DataFrame:
    return expanding_quantile(series, column, 0.5, name, keys)


def historical_var(returns: DataFrame, window: int, alpha: float) -> DataFrame:
    """-quantile(1 - alpha) of the previous `window` returns, and the normal counterpart; both NULL until
    the frame is full."""
    q = moving_quantile(returns, "ret", window, 1 - alpha, "__q")
    normal = -(F.col("__q_mean") + norm_ppf(1 - alpha) * F.col("__q_sd"))
    return q.withColumn("var_hs", -F.col("__q")).withColumn("var_normal", normal).drop("__q", "__q_mean", "__q_sd")


def filtered_var(residuals: DataFrame, alpha: float, least: int = 20) -> DataFrame:
    """-(mu + sigma * Q(z before)), the quantile of all earlier standardised residuals."""
    known = expanding_quantile(residuals, "z", 1 - alpha, "q", include_current=False, least=least)
    return known.withColumn("var_fhs", -(F.col("mu") + F.col("sigma") * F.col("q"))).drop("q")


def forward_fill(series: DataFrame, column: str) -> DataFrame:
    """The last value so far. There is no backward fill: it would look ahead."""
    return series.withColumn(column, F.last(column, ignorenulls=True).over(so_far()))


def pseudo_uniforms(series: DataFrame, column: str = "ret") -> DataFrame:
    """Average rank / (n + 1) within the series."""
    by = Window.partitionBy("series_id").orderBy(column)
    ties, everything = Window.partitionBy("series_id", column), Window.partitionBy("series_id")
    rank = F.rank().over(by) + (F.count("*").over(ties) - 1) / 2
    return series.withColumn("u", rank / (F.count("*").over(everything) + 1))


def first_component_of_two(pair: DataFrame, a: str, b: str, window: int) -> DataFrame:
    """Score of the current row on the rolling first principal component of two standardised columns: the
    loadings are (1, sign(correlation)) / sqrt 2, so no decomposition is needed. The sign follows `a`."""
    frame = last_rows(window)
    z = lambda c: (F.col(c) - F.avg(c).over(frame)) / F.stddev_samp(c).over(frame)
    cov = F.covar_samp(a, b).over(frame)
    score = (z(a) + F.signum(cov) * z(b)) / np.sqrt(2.0)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return pair.withColumn("pc1", F.when(both & (F.count(F.when(both, 1)).over(frame) == window), score))


def first_component(panel: DataFrame, columns: list[str], window: int, least: int | None = None, anchor: str | None = None, rows: int = ROWS) -> DataFrame:
    """The same for any number of columns, from the complete ones of the last `window` rows; the sign makes the
    anchor's (else the first) loading positive. NULL where the current row is incomplete or fewer than `least`
    (else `window`) complete rows are in its frame. The products of all pairs of columns are running sums over a block of
    rows, so a row costs the same whatever the window."""
    lead = columns.index(anchor) if anchor else 0
    least = max(2, window if least is None else least)

    def scores(table: pa.Table, _: int) -> list[pa.Array]:
        x = np.stack([floats(table, c) for c in columns], axis=1)
        whole = np.isfinite(x).all(axis=1)
        y = np.where(whole[:, None], x - x[whole].mean(axis=0) if whole.any() else 0.0, 0.0)
        sums = lambda v: np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0)])
        i = np.arange(len(x))
        at = i[whole & (sums(whole)[i + 1] - sums(whole)[np.maximum(0, i + 1 - window)] >= least)]
        lo = np.maximum(0, at + 1 - window)
        n, s, ss = (c[at + 1] - c[lo] for c in (sums(whole), sums(y), sums(y[:, :, None] * y[:, None, :])))
        mean = s / n[:, None]
        cov = (ss - n[:, None, None] * mean[:, :, None] * mean[:, None, :]) / (n[:, None, None] - 1)
        sd = np.sqrt(np.maximum(np.einsum("ijj->ij", cov), 0.0))
        sd = np.where(sd < 1e-12, 1.0, sd)
        load = np.linalg.eigh(cov / (sd[:, :, None] * sd[:, None, :]))[1][:, :, -1]
        out = np.full(len(x), np.nan)
        out[at] = ((y[at] - mean) / sd * load).sum(axis=1) * np.where(load[:, lead] >= 0, 1, -1)
        return [pa.array(out, pa.float64(), mask=np.isnan(out))]

    return by_block(panel, window - 1, scores, "pc1 double", rows=rows).select("series_id", "date", "pc1")


def episodes(flags: DataFrame, active: str = "active") -> DataFrame:
    """(series_id, start, end, n) of each run of active rows."""
    on = F.coalesce(F.col(active), F.lit(False))
    starts = on & ~F.coalesce(F.lag(on).over(over()), F.lit(False))
    marked = flags.withColumn("episode", F.sum(F.when(starts, 1).otherwise(0)).over(so_far())).where(on)
    return marked.groupBy("series_id", "episode").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"))


def independent_episodes(flags: DataFrame, gap_days: int = 60, active: str = "active") -> DataFrame:
    """Runs of active rows, counted anew where the gap to the run before is `gap_days` or more."""
    by = Window.partitionBy("series_id").orderBy("start")
    new = F.coalesce(F.datediff("start", F.lag("end").over(by)) >= gap_days, F.lit(True))
    return episodes(flags, active).withColumn("new", new).groupBy("series_id").agg(F.count_if("new").alias("n_episodes"), F.count("*").alias("n_runs"))


def cusum_of_squares(series: DataFrame, column: str = "ret") -> DataFrame:
    """D_k = C_k / C_T - k / T for each row."""
    everything = Window.partitionBy("series_id")
    sq = F.col(column) * F.col(column)
    d = F.sum(sq).over(so_far()) / F.sum(sq).over(everything) - F.row_number().over(over()) / F.count("*").over(everything)
    return series.withColumn("cusum", d)


def first_break(series: DataFrame, column: str = "ret", critical: float = 1.358) -> DataFrame:
    """The first split of the iterated cumulative sums of squares: where sqrt(T/2) |D_k| is largest."""
    d = cusum_of_squares(series, column).withColumn("t", F.count("*").over(Window.partitionBy("series_id"))).withColumn("k", F.row_number().over(over()))
    d = d.where("k < t").withColumn("stat", F.sqrt(F.col("t") / 2) * F.abs("cusum"))
    out = d.groupBy("series_id").agg(F.max("stat").alias("stat"), F.max_by("date", F.struct("stat", -F.col("k"))).alias("last_date_before"))
    return out.withColumn("is_break", F.col("stat") > critical)


def icss_breaks(series: DataFrame, column: str = "ret", critical: float = 1.358, least: int = 30) -> DataFrame:
    """All break dates of the iterated search: segments are split at their largest deviation of the cumulative sum of
    squares until none is beyond `critical` or a part would be shorter than half of `least`. A round splits all segments of
    all series at once: sums so far are known for every row, so a segment's largest deviation is one aggregation over its
    rows, which many tasks share, and rows of segments that don't split leave. The rounds are as many as splits are nested.
    Rows without a value don't count; of equal deviations the first one splits."""
    squares = series.where(F.col(column).isNotNull()).select("series_id", "date", (F.col(column) * F.col(column)).alias("sq"))
    placed = positioned(squares, ["series_id"], sums={"c": "sq"}).select(F.struct("series_id").alias("key"), "date", (F.col("__pos") + 1).alias("i"), "c")
    base = written(placed)
    whole = base.groupBy("key").agg(F.max("i").alias("hi"), F.max("c").alias("c_hi")).select("key", F.lit(0).cast("long").alias("lo"), "hi", F.lit(0.0).alias("c_lo"), "c_hi")
    rows, segments, found = base.withColumn("lo", F.lit(0).cast("long")), whole, []
    share = (F.col("c") - F.col("c_lo")) / (F.col("c_hi") - F.col("c_lo")) - (F.col("i") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    half = least // 2
    while True:
        inside = rows.join(segments, ["key", "lo"]).where((F.col("hi") - F.col("lo") >= least) & (F.col("c_hi") > F.col("c_lo")) & (F.col("i") < F.col("hi")))
        best = inside.groupBy("key", "lo", "hi", "c_lo", "c_hi").agg(F.max(F.struct(F.abs(share).alias("d"), (-F.col("i")).alias("j"), "c")).alias("b"))
        loc = -F.col("b.j")
        beyond = (F.sqrt((F.col("hi") - F.col("lo")) / 2) * F.col("b.d") > critical) & (F.least(loc - F.col("lo"), F.col("hi") - loc) >= half)
        split = written(best.where(beyond).select("key", "lo", "hi", "c_lo", "c_hi", loc.alias("loc"), F.col("b.c").alias("c_loc")))
        if split.isEmpty():
            break
        found.append(split.select("key", (F.col("loc") + 1).alias("i")))
        rows = written(rows.join(split.select("key", "lo", "loc"), ["key", "lo"]).select("key", "date", "i", "c", F.when(F.col("i") > F.col("loc"), F.col("loc")).otherwise(F.col("lo")).alias("lo")))
        segments = split.select("key", "lo", F.col("loc").alias("hi"), "c_lo", F.col("c_loc").alias("c_hi")).unionByName(split.select("key", F.col("loc").alias("lo"), "hi", F.col("c_loc").alias("c_lo"), "c_hi"))
    out = base.limit(0).select("key", "i")
    for breaks in found:
        out = out.unionByName(breaks)
    return base.join(out, ["key", "i"]).select("key.series_id", "date")
