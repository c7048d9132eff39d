"""Tests and regressions. Statistics are aggregates; p-values in closed form where they have one."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.windows import island_ids, last_rows, over, safe_corr  # noqa: F401

def _series():
    return Window.partitionBy("series_id")


def autocorrelations(series: DataFrame, lags: int, column: str = "ret") -> DataFrame:
    """(series_id, lag, rho, n): biased autocorrelations, sums of lagged products over the sum of squares."""
    centred = series.where(F.col(column).isNotNull()).withColumn("x", F.col(column) - F.avg(column).over(_series()))
    products = [F.sum(F.col("x") * F.col(f"x{k}")).alias(f"p{k}") for k in range(1, lags + 1)]
    lagged = centred.select("series_id", "x", *[F.lag("x", k).over(over()).alias(f"x{k}") for k in range(1, lags + 1)])
    sums = lagged.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("ss"), *products)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"p{k}") / F.col("ss")).alias("rho")) for k in range(1, lags + 1)]))
    return sums.select("series_id", "n", pairs.alias("e")).select("series_id", "n", "e.lag", "e.rho")


def chi2_sf(x: Column, df: int) -> Column:
    """Survival function of chi-square: in closed form for even degrees of freedom, else over Arrow batches."""
    if df % 2 == 0:
        return dist.chi2_sf_even(x, df)

    @F.pandas_udf("double")
    def odd(values: pd.Series) -> pd.Series:
        return values.map(lambda v: dist.chi2_sf(v, df))

    return odd(x)


def ljung_box(series: DataFrame, lags: int = 10, column: str = "ret") -> DataFrame:
    acf = autocorrelations(series, lags, column)
    q = F.max("n") * (F.max("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag")))
    out = acf.groupBy("series_id").agg(q.alias("q"))
    return out.withColumn("p_value", chi2_sf(F.col("q"), lags))


def lag_one_correlation(series: DataFrame, column: str = "ret") -> DataFrame:
    lagged = series.withColumn("prev", F.lag(column).over(over())).where(F.col("prev").isNotNull() & F.col(column).isNotNull())
    return lagged.groupBy("series_id").agg(safe_corr(F.col(column), F.col("prev")).alias("rho1"))


def moments(series: DataFrame, column: str = "ret") -> DataFrame:
    """Population and bias-corrected skewness, kurtosis (normal: 3), Jarque-Bera with its p-value."""
    x, n = F.col(column), F.col("n")
    m = series.where(x.isNotNull()).groupBy("series_id").agg(F.count(x).alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    corrected = F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")
    excess = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    jb = n / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)
    return m.select("series_id", "n", corrected.alias("skew"), (excess + 3).alias("kurtosis"), jb.alias("jb"), F.exp(-jb / 2).alias("p_value"))


def arch_lm_one(series: DataFrame, column: str = "ret") -> DataFrame:
    """Engle's test with one lag: n times the squared correlation of squares with their lag."""
    sq = series.where(F.col(column).isNotNull()).select("series_id", "date", (F.col(column) * F.col(column)).alias("y"))
    both = sq.withColumn("x", F.lag("y").over(over())).where("x IS NOT NULL")
    r = safe_corr(F.col("y"), F.col("x"))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), (F.count("*") * r * r).alias("lm"))


def least_squares(rows: DataFrame, y: str, xs: list[str], result: Callable[[int, np.ndarray, float, float, float], tuple | None], schema: str, key: str = "series_id") -> DataFrame:
    """A regression of `y` on the columns `xs` for each key: the sums of products are one aggregation, which many tasks share
    before a key's few numbers meet, and the normal equations, scaled to a unit diagonal, are solved for a key at a time.
    `result` makes the columns of `schema` after the key from (rows, coefficients, explained and residual and total sum of
    squares, the last about the mean), or None for no row. Rows with a missing value don't count."""
    names = [*xs, y]
    whole = F.lit(True)
    for c in names:
        whole &= F.col(c).isNotNull()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    grams = rows.where(whole).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("total"), *sums)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, *(f.split()[0] for f in schema.split(", "))]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    g[i, j] = g[j, i] = getattr(r, f"p{i}_{j}")
                scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))[:-1]
                gram, cross, squares = g[:-1, :-1] / np.outer(scale, scale), g[:-1, -1] / scale, g[-1, -1]
                beta = np.linalg.pinv(gram, hermitian=True) @ cross
                explained = float(beta @ gram @ beta)
                residual = squares - 2 * float(beta @ cross) + explained
                got = result(int(r.n), beta / scale, explained, residual, squares - r.total**2 / r.n)
                if got is not None:
                    out.append((getattr(r, key), *got))
            yield pd.DataFrame(out, columns=columns)

    return grams.mapInPandas(solve, f"{key} {dict(rows.dtypes)[key]}, {schema}")


_TEST = "test string, stat double, p_value double, df int"


def _share_explained(name: str, df: int) -> Callable:
    """n R2 and its chi-square p-value."""

    def result(n: int, beta: np.ndarray, explained: float, residual: float, total: float) -> tuple:
        stat = n * (1 - residual / total) if total > 0 else float("nan")
        return name, stat, dist.chi2_sf(stat, df), df

    return result


def arch_lm(series: DataFrame, lags: int, column: str = "ret") -> DataFrame:
    """Engle's test with any number of lags, from the lagged squares' cross products."""
    xs = [f"x{k}" for k in range(1, lags + 1)]
    sq = series.where(F.col(column).isNotNull()).select("series_id", "date", F.lit(1.0).alias("one"), (F.col(column) * F.col(column)).alias("y"))
    lagged = sq.select("*", *[F.lag("y", k).over(over()).alias(x) for k, x in enumerate(xs, 1)])
    return least_squares(lagged, "y", ["one", *xs], _share_explained("lm", lags), _TEST)


def arch_nr2(y: np.ndarray, lags: int) -> tuple[float, float]:
    """n R2 of y on its own lags, and its chi-square p-value."""
    x = np.column_stack([np.ones(len(y) - lags), *[y[lags - k : len(y) - k] for k in range(1, lags + 1)]])
    target = y[lags:]
    e = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
    total = ((target - target.mean()) ** 2).sum()
    stat = len(target) * (1 - (e @ e) / total) if total > 0 else float("nan")
    return stat, dist.chi2_sf(stat, lags)


def _grouped(series: DataFrame, column: str, run) -> DataFrame:
    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[column].notna()].sort_values("date")
        rows = run(pdf) if len(pdf) else []
        return pd.DataFrame([(pdf["series_id"].iloc[0], *r) for r in rows], columns=["series_id", "test", "stat", "p_value", "df"])

    return series.groupBy("series_id").applyInPandas(each, "series_id string, " + _TEST)


def sign_bias(residuals: DataFrame, column: str = "z", eps: str = "eps") -> DataFrame:
    """Joint sign and size bias: z squared on the last shock's sign and signed sizes."""
    last = residuals.where(F.col(column).isNotNull()).select("series_id", (F.col(column) * F.col(column)).alias("y"), F.lag(eps).over(over()).alias("e"))
    neg = F.when(F.col("e") < 0, 1.0).when(F.col("e").isNotNull(), 0.0)
    rows = last.select("series_id", "y", F.lit(1.0).alias("one"), neg.alias("neg"), (neg * F.col("e")).alias("low"), ((1 - neg) * F.col("e")).alias("high"))
    return least_squares(rows, "y", ["one", "neg", "low", "high"], _share_explained("sign_bias", 3), _TEST)


def sign_bias_nr2(z: np.ndarray, eps: np.ndarray) -> tuple[float, float]:
    z2, e = z[1:] ** 2, eps[:-1]
    neg = (e < 0).astype(float)
    x = np.column_stack([np.ones(len(e)), neg, neg * e, (1 - neg) * e])
    res = z2 - x @ np.linalg.lstsq(x, z2, rcond=None)[0]
    stat = len(z2) * (1 - (res @ res) / ((z2 - z2.mean()) ** 2).sum())
    return float(stat), dist.chi2_sf(stat, 3)


def variance_ratio(series: DataFrame, q: int, column: str = "ret") -> DataFrame:
    """Lo-MacKinlay: overlapping q-period variance over q times the one-period variance, with homoskedastic
    and robust z statistics."""
    base = series.where(F.col(column).isNotNull()).withColumn("x", F.col(column) - F.avg(column).over(_series()))
    rolled = base.withColumn("roll", F.sum("x").over(last_rows(q))).withColumn("rows", F.count("x").over(last_rows(q)))
    lagged = rolled.select("series_id", "x", "roll", "rows", *[F.lag("x", k).over(over()).alias(f"x{k}") for k in range(1, q)])
    sq = F.col("x") * F.col("x")
    sums = lagged.groupBy("series_id").agg(
        F.count("*").cast("double").alias("n"),
        F.sum(sq).alias("ss"),
        F.sum(F.when(F.col("rows") == q, F.col("roll") * F.col("roll"))).alias("sq_roll"),
        *[F.sum(sq * F.col(f"x{k}") * F.col(f"x{k}")).alias(f"c{k}") for k in range(1, q)],
    )
    n, m = F.col("n"), q * (F.col("n") - q + 1) * (1 - q / F.col("n"))
    vr = (F.col("sq_roll") / m) / (F.col("ss") / (n - 1))
    theta = 2.0 * (2 * q - 1) * (q - 1) / (3 * q) / n
    phi = sum((2.0 * (q - k) / q) ** 2 * n * F.col(f"c{k}") / (F.col("ss") * F.col("ss")) for k in range(1, q)) / n
    return sums.select("series_id", vr.alias("vr"), ((vr - 1) / F.sqrt(theta)).alias("z_homo"), ((vr - 1) / F.sqrt(phi)).alias("z_robust"))


def leverage_sign(returns: DataFrame, low: float = 0.1, high: float = 0.9, least: int = 5) -> DataFrame:
    """Mean log change of sigma after the lowest and the highest returns."""
    d = returns.withColumn("dlog", F.ln(F.lead("sigma").over(over()) / F.col("sigma")))
    cuts = d.groupBy("series_id").agg(F.percentile("ret", F.lit(low)).alias("lo"), F.percentile("ret", F.lit(high)).alias("hi"))
    both = d.where("dlog IS NOT NULL").join(cuts, "series_id")
    down, up = F.col("ret") <= F.col("lo"), F.col("ret") >= F.col("hi")
    out = both.groupBy("series_id").agg(
        F.avg(F.when(down, F.col("dlog"))).alias("after_low"), F.avg(F.when(up, F.col("dlog"))).alias("after_high"), F.count_if(down).alias("n_low"), F.count_if(up).alias("n_high")
    )
    return out.withColumn("leverage", (F.col("n_low") >= least) & (F.col("n_high") >= least) & (F.col("after_low") > F.col("after_high")))


def predictive_regression(df: DataFrame, y: str, x: str, horizon: int) -> DataFrame:
    """OLS of y on x with Bartlett-weighted errors over `horizon` lags; the slope's error is never below the
    plain OLS one. All sums are window or group aggregates; 8 rows at least."""
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select("series_id", "date", F.col(y).alias("y"), F.col(x).alias("x"))
    fit = both.groupBy("series_id").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx")
    )
    # with x centred the slope's variance needs only the sums of u = (x - mean) e and its lagged products
    u = both.join(fit, "series_id").withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x")).withColumn("u", (F.col("x") - F.col("mx")) * F.col("e"))
    lagged = u.select("series_id", "e", "u", *[F.lag("u", k).over(over()).alias(f"u{k}") for k in range(1, horizon + 1)])
    meat = F.sum(F.col("u") * F.col("u"))
    for k in range(1, horizon + 1):
        meat = meat + 2 * (1 - k / (horizon + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0))
    sums = lagged.groupBy("series_id").agg(meat.alias("meat"), F.sum(F.col("e") * F.col("e")).alias("sse"))
    n = F.col("n")
    hac = F.sqrt(F.greatest(F.col("meat"), F.lit(0.0)) / (F.col("sxx") * F.col("sxx")) * n / (n - 2))
    ols = F.sqrt(F.col("sse") / (n - 2) / F.col("sxx"))
    out = fit.join(sums, "series_id").where(n >= 8)
    return out.select("series_id", "n", F.col("a").alias("intercept"), F.col("b").alias("beta"), F.greatest(hac, ols).alias("se"), ols.alias("se_ols"), (F.col("b") / F.greatest(hac, ols)).alias("t_stat"), "r2")


def block_bootstrap_ci(series: DataFrame, column: str, replicates: int = 500, block: int = 60, seed: int = 7) -> DataFrame:
    """Moving-block bootstrap of the mean, 2.5 % to 97.5 %: one series a task, prefix sums make each block O(1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[column].dropna().to_numpy(float)
        n, size = len(x), min(block, len(x))
        rng = np.random.default_rng([seed, *pdf["series_id"].iloc[0].encode()])
        sums = np.concatenate(([0.0], np.cumsum(x)))
        count = -(-n // size)
        starts = rng.integers(0, n - size + 1, (replicates, count))
        width = np.full(count, size)
        width[-1] = n - size * (count - 1)
        means = (sums[starts + width] - sums[starts]).sum(axis=1) / n
        lo, hi = np.quantile(means, (0.025, 0.975))
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "mean": [x.mean()], "low": [lo], "high": [hi]})

    return series.where(F.col(column).isNotNull()).groupBy("series_id").applyInPandas(run, "series_id string, mean double, low double, high double")


def adf_kpss(series: DataFrame, column: str = "value") -> DataFrame:
    """Unit-root and stationarity tests with a constant, lags by AIC and by the usual rule, and their joint
    verdict. p-values: MacKinnon's approximation and the KPSS table (fixed values)."""

    def run(pdf: pd.DataFrame) -> list[tuple]:
        x = pdf[column].to_numpy(float)
        a, pa = adf(x)
        k, pk = kpss(x)
        return [("adf", a, pa, 0), ("kpss", k, pk, 0), ("joint", float(pa < 0.05 and pk >= 0.05), float("nan"), 0)]

    return _grouped(series, column, run)


def adf(x: np.ndarray) -> tuple[float, float]:
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(x)

    def fit(lags: int, first: int) -> tuple[float, float, float]:
        y = d[first:]
        z = np.column_stack([x[first:-1], np.ones(len(y)), *[d[first - k : len(d) - k] for k in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        e = y - z @ beta
        s2 = e @ e / (len(y) - z.shape[1])
        se = math.sqrt(s2 * np.linalg.pinv(z.T @ z)[0, 0])
        aic = len(y) * math.log(e @ e / len(y)) + 2 * z.shape[1]
        return beta[0] / se if se > 0 else float("nan"), aic, 0.0

    best = min(range(most + 1), key=lambda k: fit(k, most)[1])
    tau = fit(best, best)[0]
    # MacKinnon (1994), constant, one variable: fixed values of the response surface
    if tau > 2.74:
        return tau, 1.0
    if tau < -18.83:
        return tau, 0.0
    c = (2.1659, 1.4412, 0.038269) if tau <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return tau, dist.norm_cdf(sum(v * tau**k for k, v in enumerate(c)))


def kpss(x: np.ndarray) -> tuple[float, float]:
    n = len(x)
    e = x - x.mean()
    lags = min(int(math.ceil(12 * (n / 100) ** 0.25)), n - 1)
    s = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / s)
    return stat, float(np.interp(stat, (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)))


def icss(squared: np.ndarray, critical: float = 1.358, least: int = 30) -> list[int]:
    """Where the variance breaks: segments are split at their largest cumulative-sum deviation until none is beyond
    `critical`; both parts of a split must have half of `least` rows."""
    found, todo = [], [(0, len(squared))]
    while todo:
        lo, hi = todo.pop()
        n, total = hi - lo, squared[lo:hi].sum()
        if n < least or total <= 0:
            continue
        stat = np.sqrt(n / 2) * np.abs(np.cumsum(squared[lo:hi])[:-1] / total - np.arange(1, n) / n)
        at = lo + 1 + int(stat.argmax())
        if stat.max() > critical and min(at - lo, hi - at) >= least // 2:
            found.append(at)
            todo += [(lo, at), (at, hi)]
    return sorted(found)


def ks_distance(z: DataFrame, cdf: str = "cdf") -> DataFrame:
    """Kolmogorov distance between a column of fitted CDF values and the uniform, with the p-value of its limit law."""
    ranked = z.withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy(cdf))).withColumn("n", F.count("*").over(_series()))
    gap = F.greatest(F.col("i") / F.col("n") - F.col(cdf), F.col(cdf) - (F.col("i") - 1) / F.col("n"))
    out = ranked.groupBy("series_id").agg(F.max(gap).alias("ks"), F.max("n").alias("n"))

    @F.pandas_udf("double")
    def limit(x: pd.Series) -> pd.Series:
        return x.map(dist.kolmogorov_sf)

    root = F.sqrt("n")
    return out.withColumn("p_value", limit((root + 0.12 + 0.11 / root) * F.col("ks")))


def half_life(beta: float) -> float:
    """ln(1/2) / ln(beta) of a stationary, positive persistence; anything else raises."""
    if not 0 < beta < 1:
        raise ValueError("a half-life needs a persistence between 0 and 1")
    return math.log(0.5) / math.log(beta)


def persistence(kind: str, alpha: float, gamma: float, beta: float) -> float:
    """What a shock leaves to the next day's variance: |beta| of a log variance (egarch), alpha + gamma / 2 + beta of
    a variance with two sides (gjr), alpha + beta of a symmetric one."""
    return {"egarch": abs(beta), "gjr": alpha + gamma / 2 + beta, "symmetric": alpha + beta}[kind]
