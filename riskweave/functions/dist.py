"""Distribution functions on numpy arrays and as Spark columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def chi2_sf_even(x: Column, df: int) -> Column:
    """Survival function of chi-square with even degrees of freedom, as a column: exp(-x/2) times a
    truncated exponential series."""
    half, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for j in range(1, df // 2):
        term = term * half / j
        total = total + term
    return F.exp(-half) * total


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, df: float) -> float:
    """Inverse by bisection, on a bracket that doubles."""
    if p == 0.5:
        return 0.0
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
        if high - low < 1e-13 * max(1, abs(mid)):
            break
    return (low + high) / 2


def t_cdf_grid(df: float, reach: float = 60.0, n: int = 4001) -> tuple[np.ndarray, np.ndarray]:
    """A monotone grid of (x, cdf), for interpolation over large arrays both ways."""
    x = np.sinh(np.linspace(-math.asinh(reach), math.asinh(reach), n))
    return x, np.array([t_cdf(v, df) for v in x])


def t_logpdf(x: np.ndarray, df: float) -> np.ndarray:
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df)


def std_t_logpdf(z: np.ndarray, df: float) -> np.ndarray:
    """Student t scaled to unit variance."""
    s = math.sqrt((df - 2) / df)
    return t_logpdf(z / s, df) - math.log(s)


def skewt_constants(df: float, lam: float) -> tuple[float, float, float]:
    """a, b, c of Hansen's (1994) skewed t."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi * (df - 2))
    a = 4 * lam * c * (df - 2) / (df - 1)
    return a, math.sqrt(1 + 3 * lam * lam - a * a), c


def skewt_logpdf(z: np.ndarray, df: float, lam: float) -> np.ndarray:
    a, b, c = skewt_constants(df, lam)
    side = np.where(z < -a / b, 1 - lam, 1 + lam)
    return math.log(b * c) - (df + 1) / 2 * np.log1p(((b * z + a) / side) ** 2 / (df - 2))


def skewt_cdf(z: float, df: float, lam: float) -> float:
    a, b, _ = skewt_constants(df, lam)
    s = math.sqrt(df / (df - 2))
    if z < -a / b:
        return (1 - lam) * t_cdf(s * (b * z + a) / (1 - lam), df)
    return (1 - lam) / 2 + (1 + lam) * (t_cdf(s * (b * z + a) / (1 + lam), df) - 0.5)


def kolmogorov_sf(x: float) -> float:
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
