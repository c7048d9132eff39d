"""Diagnostics before and after a volatility model: one verdict row for each test and series.

Rows are (series_id, code, statistic, p_value, status), status PASS, WARN or FAIL. A series is one group, read
once for all tests. `plans.reports.blocking` names the failures that forbid a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from . import stats
from . import volatility as vol

ROWS = "series_id string, code string, statistic double, p_value double, status string"
ARCH_LAGS = (5, 10)
BOX_LAGS = (10, 20)
Row = tuple[str, float | None, float | None, str]


def joint_status(adf_p: float, kpss_p: float, significance: float = 0.05) -> str:
    """The two tests' hypotheses are opposite: both must point to stationarity, or both away from it."""
    adf, kpss = adf_p < significance, kpss_p < significance
    return "PASS" if adf and not kpss else "FAIL" if kpss and not adf else "WARN"


def before_rows(x: np.ndarray, significance: float = 0.05, rho_limit: float = 0.15, critical: float = 1.358) -> list[Row]:
    """Stationarity (A1), conditional heteroskedasticity (A2), the mean (A3), normality (A4), variance breaks (A5)."""
    (tau, adf_p), (level, kpss_p) = stats.adf(x), stats.kpss(x)
    out: list[Row] = [("A1.ADF", tau, adf_p, "PASS" if adf_p < significance else "FAIL"), ("A1.KPSS", level, kpss_p, "FAIL" if kpss_p < significance else "PASS"), ("A1.joint", tau, adf_p, joint_status(adf_p, kpss_p, significance))]
    for q in ARCH_LAGS:
        lm, p = stats.arch_nr2(x * x, q)
        out.append((f"A2.ARCH_LM_{q}", lm, p, "PASS" if p < significance else "WARN"))
    a, b = x[1:], x[:-1]
    rho = float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0
    out.append(("A3.rho1", rho, None, "WARN" if abs(rho) > rho_limit else "PASS"))
    for lag in BOX_LAGS:
        q_, p = vol.ljung_box(x, lag)
        out.append((f"A3.LjungBox_{lag}", q_, p, "WARN" if p < significance else "PASS"))
    c = x - x.mean()
    m2 = float(np.mean(c**2)) or 1e-300
    jb = len(x) / 6 * (float(np.mean(c**3)) ** 2 / m2**3 + (float(np.mean(c**4)) / m2**2 - 3) ** 2 / 4)
    out.append(("A4.JarqueBera", jb, math.exp(-jb / 2), "WARN" if jb > -2 * math.log(significance) else "PASS"))
    sq = x * x
    sup = float(np.sqrt(len(x) / 2) * np.abs(np.cumsum(sq)[:-1] / sq.sum() - np.arange(1, len(x)) / len(x)).max()) if sq.sum() > 0 else float("nan")
    p = dist.kolmogorov_sf(sup) if math.isfinite(sup) else float("nan")
    out.append(("A5.CUSUM", sup, p, "PASS" if p >= significance else "WARN"))
    breaks = stats.icss(sq, critical)
    out.append(("A5.ICSS", float(len(breaks)), None, "WARN" if breaks else "PASS"))
    return out


def after_rows(z: np.ndarray, eps: np.ndarray | None, family: str, significance: float = 0.05) -> list[Row]:
    """Residuals: white (B1), without ARCH left (B2), without sign and size bias (B3; needs eps)."""
    lag = BOX_LAGS[0]
    good = lambda p: "PASS" if p > significance else "FAIL"
    q, p = vol.ljung_box(z, lag)
    out: list[Row] = [("B1.LjungBox_z", q, p, good(p))]
    q, p = vol.ljung_box(z * z, lag)
    out.append(("B2.LjungBox_z2", q, p, good(p)))
    for k in ARCH_LAGS:
        lm, p = stats.arch_nr2(z * z, k)
        out += [(name, lm, p, good(p)) for name in (f"B2.ARCH_LM_{k}", *(["B2.ARCH_LM"] if k == max(ARCH_LAGS) else []))]
    if eps is None:
        return [*out, ("B3.EngleNg", None, None, "FAIL")]
    bias, p = stats.sign_bias_nr2(z, eps)
    return [*out, ("B3.EngleNg", bias, p, "PASS" if p >= significance else "FAIL" if family in ("egarch", "gjr") else "WARN")]


def assumed_cdf(density: str, nu: float | None = None, lam: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    if density == "normal":
        return lambda z: np.array([dist.norm_cdf(v) for v in z])
    if density == "t":
        scale = math.sqrt(nu / (nu - 2))
        return lambda z: np.array([dist.t_cdf(v * scale, nu) for v in z])
    return lambda z: np.array([dist.skewt_cdf(v, nu, lam) for v in z])


def assumed_ppf(density: str, p: np.ndarray, nu: float | None = None, lam: float = 0.0) -> np.ndarray:
    """The quantiles beside it, read off a fine grid of the CDF."""
    grid = np.sinh(np.linspace(-4.5, 4.5, 2001))
    return np.interp(p, assumed_cdf(density, nu, lam)(grid), grid)


def distribution_row(z: np.ndarray, cdf: Callable[[np.ndarray], np.ndarray], significance: float = 0.05) -> Row:
    """Kolmogorov-Smirnov against the assumed distribution (B4); never a failure."""
    u = np.sort(cdf(z))
    n = len(u)
    d = float(max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max()))
    p = dist.kolmogorov_sf((math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d)
    return ("B4.KS", d, p, "PASS" if p > significance else "WARN")


def stationarity_row(family: str, omega: float, alpha: float, gamma: float, beta: float, frontier: float = 0.999) -> Row:
    """Positivity and persistence below one (B5); close to one is a warning."""
    p = stats.persistence(family, alpha, gamma, beta)
    bad = family == "gjr" and (omega <= 0 or alpha < 0 or alpha + gamma < 0 or beta < 0)
    return ("B5.stationarity", p, None, "FAIL" if bad or not 0 < p < 1 else "WARN" if p > frontier else "PASS")


def optimiser_rows(converged: bool, logliks: list[float] | None, least: int = 5, tolerance: float = 0.01) -> list[Row]:
    """Convergence, and searches from other places that end at the same likelihood (B6)."""
    fine = [v for v in logliks or [] if math.isfinite(v)]
    spread = max(fine) - min(fine) if len(fine) >= least else None
    return [("B6.convergence", float(converged), None, "PASS" if converged else "FAIL"), ("B6.restarts", spread, None, "PASS" if spread is not None and spread <= tolerance else "FAIL")]


def _each(series: DataFrame, columns: list[str], rows: Callable[[pd.DataFrame], list[Row]], least: int = 60) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=columns).sort_values("date")
        found = rows(pdf) if len(pdf) >= least else [("A0.length", float(len(pdf)), None, "FAIL")]
        name = pdf["series_id"].iloc[0] if len(pdf) else None
        return pd.DataFrame([(name, *r) for r in found], columns=["series_id", "code", "statistic", "p_value", "status"])

    return series.groupBy("series_id").applyInPandas(run, ROWS)


def pre_estimation(series: DataFrame, column: str = "ret") -> DataFrame:
    """What a series must show before a volatility model is fitted to it."""
    return _each(series, [column], lambda pdf: before_rows(pdf[column].to_numpy(float)))


def residual_checks(residuals: DataFrame, family: str, z: str = "z", eps: str | None = "eps") -> DataFrame:
    """B1 to B3 of standardised residuals in a column."""
    return _each(residuals, [c for c in (z, eps) if c], lambda pdf: after_rows(pdf[z].to_numpy(float), pdf[eps].to_numpy(float) if eps else None, family))


def post_estimation(returns: DataFrame, spec: vol.Spec = vol.Spec("gjr", "constant", "t"), restarts: int = 4, column: str = "ret") -> DataFrame:
    """Fit the model to each series, from `restarts` further places too, and judge it."""

    def rows(pdf: pd.DataFrame) -> list[Row]:
        f = vol.fit(pdf[column].to_numpy(float), spec, restarts=restarts, errors=False)
        family = spec.kind if spec.asymmetric or spec.kind == "egarch" else "symmetric"
        cdf = assumed_cdf(spec.density, f.params.get("nu"), f["lam"])
        return [*after_rows(f.z, f.eps, family), distribution_row(f.z, cdf), stationarity_row(family, f["omega"], f["alpha"], f["gamma"], f["beta"]), *optimiser_rows(f.converged, f.restarts)]

    return _each(returns, [column], rows, 250)


def quantile_pairs(residuals: DataFrame, density: str = "normal", nu: float | None = None, lam: float = 0.0, column: str = "z") -> DataFrame:
    """(series_id, place, observed, assumed): the data of a QQ plot, every residual a point."""
    ranked = residuals.where(F.col(column).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(column)))
    ranked = ranked.withColumn("share", (F.col("place") - 0.5) / F.count("*").over(Window.partitionBy("series_id")))

    @F.pandas_udf("double")
    def assumed(p: pd.Series) -> pd.Series:
        return pd.Series(assumed_ppf(density, p.to_numpy(float), nu, lam))

    return ranked.select("series_id", "place", F.col(column).alias("observed"), assumed("share").alias("assumed"))
