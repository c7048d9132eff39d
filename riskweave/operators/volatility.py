"""Conditional volatility by maximum likelihood: GJR and EGARCH variances with a constant, AR(1) or ARMA(1,1)
mean and normal, Student t or skewed t innovations.

A series is one group, so a panel fits in parallel; likelihoods and the optimiser are numpy only. What a model must
satisfy (enough rows, no stale zeros, convergence, white residuals, the sign of the leverage) comes back as a
`status` for each series, so that one bad series doesn't end a panel; `require_ok` turns it into an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.windows import require

MEAN_ABS = math.sqrt(2 / math.pi)


# --- optimiser -----------------------------------------------------------------------------------------


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.2, rounds: int = 600, tolerance: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """Downhill simplex; (argument, value, converged)."""
    n = len(start)
    simplex = [np.array(start, float)] + [np.array(start, float) + step * (abs(start[i]) + 0.5) * np.eye(n)[i] for i in range(n)]
    values = [f(s) for s in simplex]
    for _ in range(rounds):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance * (abs(values[0]) + 1e-9):
            return simplex[0], values[0], True
        centre = np.mean(simplex[:-1], axis=0)
        trial = centre + (centre - simplex[-1])
        ft = f(trial)
        if ft < values[0]:
            further = centre + 2 * (centre - simplex[-1])
            ff = f(further)
            trial, ft = (further, ff) if ff < ft else (trial, ft)
        elif ft >= values[-2]:
            trial = centre + 0.5 * ((trial if ft < values[-1] else simplex[-1]) - centre)
            ft = f(trial)
            if ft >= values[-1]:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]
                values = [values[0]] + [f(s) for s in simplex[1:]]
                continue
        simplex[-1], values[-1] = trial, ft
    best = int(np.argmin(values))
    return simplex[best], values[best], False


# --- models --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    kind: str = "gjr"  # or egarch
    mean: str = "constant"  # ar, arma
    density: str = "normal"  # t, skewt
    asymmetric: bool = True

    @property
    def names(self) -> list[str]:
        mean = {"constant": ["const"], "ar": ["const", "phi"], "arma": ["const", "phi", "theta"]}[self.mean]
        shape = {"normal": [], "t": ["nu"], "skewt": ["nu", "lam"]}[self.density]
        return [*mean, "omega", "alpha", *(["gamma"] if self.asymmetric else []), "beta", *shape]


@dataclass
class Fit:
    spec: Spec
    params: dict[str, float]
    loglik: float
    converged: bool
    eps: np.ndarray
    #: variances of every row and of the next one
    var: np.ndarray
    errors: dict[str, float] = field(default_factory=dict)
    #: the log likelihoods of all searches
    restarts: list[float] = field(default_factory=list)
    #: the optimum in the optimiser's terms, to start a later fit from
    unbounded: np.ndarray | None = None

    def __getitem__(self, name: str) -> float:
        return self.params.get(name, 0.0)

    @property
    def sigma(self) -> np.ndarray:
        return np.sqrt(self.var[:-1])

    @property
    def sigma_next(self) -> float:
        return math.sqrt(self.var[-1])

    @property
    def z(self) -> np.ndarray:
        return self.eps / self.sigma

    @property
    def aic(self) -> float:
        return 2 * len(self.params) - 2 * self.loglik

    @property
    def bic(self) -> float:
        return math.log(len(self.eps)) * len(self.params) - 2 * self.loglik

    def p_value(self, name: str) -> float | None:
        """Two-sided, from the robust error."""
        if not self.errors.get(name):
            return None
        return 2 * (1 - dist.norm_cdf(abs(self.params[name] / self.errors[name])))

    @property
    def persistence(self) -> float:
        if self.spec.kind == "egarch":
            return abs(self["beta"])
        return self["alpha"] + self["gamma"] / 2 + self["beta"]

    @property
    def half_life(self) -> float | None:
        base = self["beta"] if self.spec.kind == "egarch" else self.persistence
        return math.log(0.5) / math.log(base) if 0 < base < 1 else None

    def mean_next(self, last: float) -> float:
        return self["const"] + self["phi"] * last + self["theta"] * float(self.eps[-1])


def gjr_variance(eps: np.ndarray, omega: float, alpha: float, gamma: float, beta: float, first: float) -> np.ndarray:
    """Variances of each row and, last, of the next one."""
    out = np.empty(len(eps) + 1)
    v = out[0] = first
    push = omega + np.where(eps < 0, alpha + gamma, alpha) * eps * eps
    for t, p in enumerate(push.tolist()):
        v = max(p + beta * v, 1e-300)
        out[t + 1] = v
    return out


def egarch_variance(eps: np.ndarray, omega: float, alpha: float, gamma: float, beta: float, first: float) -> np.ndarray:
    out = np.empty(len(eps) + 1)
    log_v = out[0] = math.log(first)
    for t, e in enumerate(eps.tolist()):
        z = e * math.exp(-0.5 * log_v)
        log_v = max(-60.0, min(60.0, omega + alpha * (abs(z) - MEAN_ABS) + gamma * z + beta * log_v))
        out[t + 1] = log_v
    return np.exp(out)


def mean_residuals(r: np.ndarray, const: float, phi: float = 0.0, theta: float = 0.0) -> np.ndarray:
    """r_t - const - phi r_{t-1} - theta e_{t-1}; the first row is taken from the unconditional mean."""
    e = r - const
    e[1:] -= phi * r[:-1]
    e[0] = r[0] - const / (1 - phi)
    if theta:
        last = 0.0
        out = []
        for v in e.tolist():
            last = v - theta * last
            out.append(last)
        e = np.array(out)
    return e


def filtered(spec: Spec, params: dict[str, float], r: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, variances of each row and the next) of fixed parameters."""
    eps = mean_residuals(r, params["const"], params.get("phi", 0.0), params.get("theta", 0.0))
    variance = egarch_variance if spec.kind == "egarch" else gjr_variance
    return eps, variance(eps, params["omega"], params["alpha"], params.get("gamma", 0.0), params["beta"], first)


def log_likelihoods(spec: Spec, params: dict[str, float], r: np.ndarray, first: float) -> np.ndarray:
    """Of each row."""
    eps, var = filtered(spec, params, r, first)
    v = var[:-1]
    z = eps / np.sqrt(v)
    if spec.density == "normal":
        ll = -0.5 * (math.log(2 * math.pi) + z * z)
    elif spec.density == "t":
        ll = dist.std_t_logpdf(z, params["nu"])
    else:
        ll = dist.skewt_logpdf(z, params["nu"], params["lam"])
    return ll - 0.5 * np.log(v)


def _squash(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _shares(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def to_params(spec: Spec, q: np.ndarray) -> dict[str, float]:
    """Unbounded numbers to parameters. A GJR variance is given by its long-run level, its persistence, and the
    shares of it that the last up move, the last down move and the memory have; an EGARCH by its long-run log level."""
    out, k = {}, 0
    m = q[0]
    phi = 0.995 * math.tanh(q[1]) if spec.mean != "constant" else 0.0
    k = 1
    if spec.mean != "constant":
        k = 2
    if spec.mean == "arma":
        out["theta"] = 0.995 * math.tanh(q[2])
        k = 3
    out |= {"const": m * (1 - phi)} | ({"phi": phi} if spec.mean != "constant" else {})
    level = math.exp(max(-30.0, min(30.0, q[k])))
    if spec.kind == "gjr":
        persistence = 0.9995 * _squash(q[k + 1])
        if spec.asymmetric:
            up, down, memory = persistence * _shares(np.array([q[k + 2], q[k + 3], 0.0]))
            out |= {"alpha": 2 * up, "gamma": 2 * (down - up), "beta": memory}
            k += 4
        else:
            react = persistence * _squash(q[k + 2])
            out |= {"alpha": react, "beta": persistence - react}
            k += 3
        out["omega"] = level * (1 - persistence)
    else:
        beta = math.tanh(q[k + 1])
        out |= {"alpha": q[k + 2], "beta": beta, "omega": math.log(level) * (1 - beta)}
        k += 3
        if spec.asymmetric:
            out["gamma"] = q[k]
            k += 1
    if spec.density != "normal":
        out["nu"] = 2.05 + math.exp(max(-5.0, min(5.0, q[k])))
        if spec.density == "skewt":
            out["lam"] = 0.99 * math.tanh(q[k + 1])
    return {n: float(out[n]) for n in spec.names}


def starts(spec: Spec) -> list[np.ndarray]:
    """A few places to begin, for data of unit variance."""
    mean = {"constant": [0.0], "ar": [0.0, 0.0], "arma": [0.0, 0.1, 0.0]}[spec.mean]
    shape = {"normal": [], "t": [1.5], "skewt": [1.5, 0.0]}[spec.density]
    if spec.kind == "gjr":
        sides = [[-3.4, -2.6], [-2.4, -2.4]] if spec.asymmetric else [[-2.4], [-1.5]]
        variance = [[0.0, p, *s] for p in (2.0, 3.5) for s in sides]
    else:
        tilt = [[0.0], [-0.08]] if spec.asymmetric else [[]]
        variance = [[0.0, b, a, *g] for b in (1.5, 2.2) for a in (0.1, 0.25) for g in tilt]
    return [np.array([*mean, *v, *shape]) for v in variance]


def fit(r: np.ndarray, spec: Spec, restarts: int = 0, seed: int = 7, begin: np.ndarray | None = None, errors: bool = True) -> Fit:
    """The maximum of the likelihood; with `restarts`, that many further searches from other places, whose
    likelihoods the fit reports. `begin` replaces the search for a start (an earlier fit's `unbounded`)."""
    r = np.asarray(r, float)
    sd, centre = float(r.std(ddof=1)) or 1e-8, float(r.mean())
    x = (r - centre) / sd

    def loss(q: np.ndarray) -> float:
        try:
            out = -float(log_likelihoods(spec, to_params(spec, q), x, 1.0).sum())
        except (OverflowError, ValueError, ZeroDivisionError):
            return 1e12
        return out if math.isfinite(out) else 1e12

    first = [begin] if begin is not None else starts(spec)
    q = min(first, key=loss)
    found = []
    rng = np.random.default_rng(seed)
    for k in range(1 + restarts):
        at = q if k == 0 else q + rng.normal(0, 0.4, len(q))
        at, value, ok = nelder_mead(loss, at, rounds=500)
        if begin is None:  # a second search from the first one's end leaves flat spots
            at, value, ok = nelder_mead(loss, at, step=0.05, rounds=500)
        found.append((value, ok, at))
    value, ok, best = min(found, key=lambda f: f[0])
    scaled = to_params(spec, best)
    names, n = spec.names, len(r)
    values = np.array([scaled[k] for k in names])
    # back from the scale of x: the mean moves and stretches, the variance stretches
    move = np.eye(len(names))
    at = {k: i for i, k in enumerate(names)}
    shift = np.zeros(len(names))
    move[at["const"], at["const"]] = sd
    shift[at["const"]] = centre * (1 - scaled.get("phi", 0.0))
    if "phi" in at:
        move[at["const"], at["phi"]] = -centre
    if spec.kind == "gjr":
        move[at["omega"], at["omega"]] = sd * sd
    else:
        shift[at["omega"]] = math.log(sd * sd) * (1 - scaled["beta"])
        move[at["omega"], at["beta"]] = -math.log(sd * sd)
    own = values.copy()
    own[at["const"]] *= sd
    if spec.kind == "gjr":
        own[at["omega"]] *= sd * sd
    params = {k: float(v) for k, v in zip(names, own + shift)}
    eps, var = filtered(spec, params, r, sd * sd)
    out = Fit(spec, params, -value - n * math.log(sd), ok, eps, var, restarts=[-f[0] - n * math.log(sd) for f in found], unbounded=best)
    if errors:
        out.errors = robust_errors(spec, values, x, move)
    return out


def robust_errors(spec: Spec, values: np.ndarray, x: np.ndarray, move: np.ndarray) -> dict[str, float]:
    """Sandwich errors from differences of the likelihood, carried over by the linear map `move`."""
    names, k = spec.names, len(values)
    of = lambda v: log_likelihoods(spec, dict(zip(names, v.tolist())), x, 1.0)
    h = 1e-4 * np.maximum(np.abs(values), 1e-2)
    try:
        step = np.diag(h)
        score = np.stack([(of(values + step[i]) - of(values - step[i])) / (2 * h[i]) for i in range(k)], axis=1)
        centre = of(values).sum()
        hess = np.empty((k, k))
        for i in range(k):
            hess[i, i] = (of(values + step[i]).sum() - 2 * centre + of(values - step[i]).sum()) / h[i] ** 2
            for j in range(i):
                cross = of(values + step[i] + step[j]).sum() - of(values + step[i] - step[j]).sum() - of(values - step[i] + step[j]).sum() + of(values - step[i] - step[j]).sum()
                hess[i, j] = hess[j, i] = cross / (4 * h[i] * h[j])
        bread = np.linalg.pinv(-hess)
        cov = move @ bread @ (score.T @ score) @ bread @ move.T
    except (OverflowError, ValueError, np.linalg.LinAlgError):
        return {}
    return {n: math.sqrt(v) if v > 0 and math.isfinite(v) else 0.0 for n, v in zip(names, np.diag(cov))}


# --- gates ---------------------------------------------------------------------------------------------


def ljung_box(x: np.ndarray, lags: int = 10) -> tuple[float, float]:
    x = x - x.mean()
    n, ss = len(x), float(x @ x)
    if ss <= 0 or n <= lags:
        return 0.0, 1.0
    rho = np.array([(x[k:] @ x[:-k]) / ss for k in range(1, lags + 1)])
    q = n * (n + 2) * float((rho**2 / (n - np.arange(1, lags + 1))).sum())
    return q, dist.chi2_sf(q, lags)


def zero_run_excess(r: np.ndarray, floor: int = 2, least_share: float = 0.05, k: float = 3.0) -> bool:
    """Whether the longest run of zeros is beyond what independent changes give."""
    zero = r == 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], zero, [False])).astype(int)))
    longest = int((edges[1::2] - edges[::2]).max(initial=0))
    p = zero.mean()
    bound = floor
    if least_share <= p < 1:
        bound = max(floor, math.ceil(math.log(len(r) * (1 - p)) / math.log(1 / p) + k * math.sqrt(math.pi**2 / (6 * math.log(1 / p) ** 2) + 1 / 12)))
    return longest > bound


def leverage_gap(r: np.ndarray, sigma: np.ndarray, tail: float = 0.1, least: int = 20) -> float | None:
    """How much more sigma's log rises after the lowest returns than after the highest; None with too few."""
    growth = np.log(sigma[1:] / sigma[:-1])
    low, high = np.quantile(r, tail), np.quantile(r, 1 - tail)
    down, up = growth[r[:-1] <= low], growth[r[:-1] >= high]
    return float(down.mean() - up.mean()) if min(len(down), len(up)) >= least else None


def nu_warning(nu: float | None, low: float = 4.0, high: float = 20.0) -> str | None:
    if nu is None:
        return None
    return "no fourth moment" if nu < low else "near normal" if nu > high else None


def require_ok(fits: DataFrame) -> DataFrame:
    """Fail the query at the first series whose status isn't ok."""
    return require(fits, F.col("status") == "ok", "a model is not valid")


# --- EGARCH panels -------------------------------------------------------------------------------------

EGARCH = (
    "series_id string, status string, mean string, density string, n int, const double, phi double, theta double, omega double, alpha double, gamma double, beta double, nu double, lam double, "
    "loglik double, aic double, bic double, half_life double, gamma_p double, leverage_confirmed boolean, symmetric_loglik double, lb_stat double, lb_p double, rho1 double, matrix_pricing boolean, nu_warning string, sigma_next double"
)


def _row(schema: str, values: dict) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame([[values.get(n) for n in names]], columns=names)


def egarch_model(r: np.ndarray, least: int = 1000, densities: tuple[str, ...] = ("t", "skewt"), means: tuple[str, ...] = ("ar", "arma"), lags: int = 10, significance: float = 0.05, strict: bool = True) -> tuple[dict, Fit | None]:
    """An EGARCH with the first mean whose standardised residuals are white, and the density of least BIC. What is
    found wrong is the status. `strict`: residuals that aren't white are an error, otherwise only reported."""
    if "normal" in densities:
        raise ValueError("normal innovations are not allowed here")
    _, first_p = ljung_box(r, lags)
    x = r - r.mean()
    rho1 = float(x[1:] @ x[:-1] / (x @ x)) if len(r) > 2 and x @ x > 0 else 0.0
    out: dict = {"n": len(r), "rho1": rho1, "matrix_pricing": bool(rho1 > 0.15 and first_p < significance)}
    if len(r) < least:
        return out | {"status": "too short"}, None
    if zero_run_excess(r):
        return out | {"status": "stale zeros"}, None
    best = None
    for mean in means:
        fits = [f for f in (fit(r, Spec("egarch", mean, d), errors=False) for d in densities) if f.converged]
        if not fits:
            return out | {"status": "not converged"}, None
        best = min(fits, key=lambda f: f.bic)
        q, p = ljung_box(best.z, lags)
        if p > significance:
            break
    scaled = fit(r, best.spec, begin=best.unbounded)
    best = scaled if scaled.loglik >= best.loglik - 1e-6 else best
    gamma_p = best.p_value("gamma")
    significant = gamma_p is not None and gamma_p < significance
    gap = leverage_gap(r, best.sigma, least=20 if len(r) >= 400 else 12)
    symmetric = None if significant else fit(r, Spec("egarch", best.spec.mean, best.spec.density, False), errors=False).loglik
    status = "ok"
    if best.half_life is None:
        status = "not stationary"
    elif strict and p <= significance:
        status = "residuals are autocorrelated"
    elif significant and best["gamma"] > 0:
        status = "gamma has the wrong sign"
    elif gap is None or gap <= 0:
        status = "sigma does not rise more after losses"
    return out | best.params | {
        "status": status, "mean": best.spec.mean, "density": best.spec.density, "loglik": best.loglik, "aic": best.aic, "bic": best.bic, "half_life": best.half_life, "gamma_p": gamma_p,
        "leverage_confirmed": bool(significant and best["gamma"] < 0), "symmetric_loglik": symmetric, "lb_stat": q, "lb_p": p, "nu_warning": nu_warning(best.params.get("nu")), "sigma_next": best.sigma_next,
    }, best


def egarch_fit_panel(returns: DataFrame, least: int = 1000, column: str = "ret") -> DataFrame:
    """One row a series: AR(1), then ARMA(1,1) where residuals aren't white; t against skewed t by BIC; where the
    asymmetry isn't significant the symmetric model's likelihood beside it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("date")[column].dropna().to_numpy(float)
        return _row(EGARCH, {"series_id": pdf["series_id"].iloc[0]} | egarch_model(r, least)[0])

    return returns.groupBy("series_id").applyInPandas(run, EGARCH)


def ranked_panel(fits: DataFrame, quality: dict[str, int]) -> DataFrame:
    """The comparative table: fits in the order of their series' quality rank, unranked ones last."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in quality.items() for x in kv]), F.col("series_id")) if quality else F.lit(None).cast("int")
    return fits.withColumn("quality_rank", rank).orderBy(F.col("quality_rank").asc_nulls_last(), "series_id")


PARAMETERS = "series_id string, name string, value double, std_err double, t_stat double, p_value double"


def egarch_parameters(returns: DataFrame, spec: Spec = Spec("egarch", "ar", "t"), column: str = "ret") -> DataFrame:
    """Every parameter with its robust error, t statistic and p-value, one row each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit(pdf.sort_values("date")[column].dropna().to_numpy(float), spec)
        rows = [(pdf["series_id"].iloc[0], k, v, f.errors.get(k), v / f.errors[k] if f.errors.get(k) else None, f.p_value(k)) for k, v in f.params.items()]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARAMETERS.split(", ")])

    return returns.groupBy("series_id").applyInPandas(run, PARAMETERS)


def egarch_paths(f: Fit, horizon: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Mean simulated variance at every horizon up to the last, from resampled standardised residuals."""
    log_v, z = np.full(draws, math.log(f.var[-1])), f.z
    out = np.empty(horizon)
    for h in range(horizon):
        out[h] = np.exp(log_v).mean()
        e = rng.choice(z, draws)
        log_v = np.clip(f["omega"] + f["alpha"] * (np.abs(e) - MEAN_ABS) + f["gamma"] * e + f["beta"] * log_v, -60, 60)
    return out


def egarch_forecast(returns: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 22), draws: int = 10_000, seed: int = 7, spec: Spec = Spec("egarch", "ar", "t"), column: str = "ret") -> DataFrame:
    """(series_id, horizon, variance, volatility), simulated; the draws of a series depend on the seed and its name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["series_id"].iloc[0]
        f = fit(pdf.sort_values("date")[column].dropna().to_numpy(float), spec, errors=False)
        path = egarch_paths(f, max(horizons), draws, np.random.default_rng([seed, *name.encode()]))
        return pd.DataFrame({"series_id": name, "horizon": list(horizons), "variance": [path[h - 1] for h in horizons], "volatility": [math.sqrt(path[h - 1]) for h in horizons]})

    return returns.groupBy("series_id").applyInPandas(run, "series_id string, horizon int, variance double, volatility double")


# --- the monthly model, whose layers may differ in what they may do --------------------------------------

PRIMARY = "primary_monthly"
LAYERED = EGARCH + ", layer string, adf_p double, kpss_p double, warning string, may_originate boolean"


def may_originate(layer: str) -> bool:
    """Only the primary monthly layer may originate a signal; daily layers refine its timing."""
    return layer == PRIMARY


def originated(signals: DataFrame, layer: str, fired: str = "fired") -> DataFrame:
    """The rows that fired, if the layer may originate them; otherwise an error."""
    if not may_originate(layer):
        raise ValueError(f"layer {layer} may refine timing only, not originate a signal")
    return signals.where(F.col(fired))


def layered_egarch(levels: DataFrame, layer: str = PRIMARY, least: int = 120, column: str = "value") -> DataFrame:
    """EGARCH-t of minus the changes of a level, one row a series: the changes must be stationary by both tests; a
    constant mean, then AR(1); residuals that aren't white are an error on the primary layer, a warning elsewhere."""
    from .stats import adf, kpss

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        change = np.diff(pdf.sort_values("date")[column].dropna().to_numpy(float))
        out: dict = {"series_id": pdf["series_id"].iloc[0], "layer": layer, "may_originate": may_originate(layer), "n": len(change)}
        if len(change) < least:
            return _row(LAYERED, out | {"status": "too short"})
        adf_p, kpss_p = adf(change)[1], kpss(change)[1]
        out |= {"adf_p": adf_p, "kpss_p": kpss_p}
        if adf_p > 0.05 or kpss_p < 0.05:
            return _row(LAYERED, out | {"status": "changes are not stationary"})
        found, _ = egarch_model(-change, least, ("t",), ("constant", "ar"), strict=may_originate(layer))
        warning = "residuals are autocorrelated" if found.get("lb_p") is not None and found["lb_p"] <= 0.05 else None
        return _row(LAYERED, out | found | {"warning": warning})

    return levels.groupBy("series_id").applyInPandas(run, LAYERED)


def conditional_volatility(returns: DataFrame, spec: Spec = Spec("egarch", "constant", "t"), column: str = "ret") -> DataFrame:
    """(series_id, date, sigma, z, eps): the fitted path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[column].notna()].sort_values("date")
        f = fit(pdf[column].to_numpy(float), spec, errors=False)
        return pdf[["series_id", "date"]].assign(sigma=f.sigma, z=f.z, eps=f.eps)

    return returns.groupBy("series_id").applyInPandas(run, "series_id string, date date, sigma double, z double, eps double")


# --- GJR: a cascade of densities ---------------------------------------------------------------------------

# The densities tried, with or without asymmetry.
CASCADE = (("skewt", True), ("t", True), ("t", False), ("normal", True))
GJR = "series_id string, status string, mean string, density string, asymmetric boolean, n int, const double, phi double, omega double, alpha double, gamma double, beta double, nu double, lam double, loglik double, persistence double, candidates int, sigma_next double"


def usable(f: Fit, r: np.ndarray) -> bool:
    """Whether the search ended, everything is finite, the level that the mean returns to lies among the data (between
    the first and the last percentile) and the usual volatility among the sizes of the data's moves."""
    if not (f.converged and np.isfinite([f.loglik, f.persistence, *f.params.values(), *f.sigma]).all()):
        return False
    level = f["const"] / (1 - f["phi"]) if f["phi"] < 1 else math.inf
    low, high = np.quantile(r, (0.01, 0.99))
    moves = np.abs(r - np.median(r))
    return low <= level <= high and moves.min() < np.median(f.sigma) < moves.max()


def gjr_cascade(r: np.ndarray, errors: bool = False) -> tuple[Fit | None, int]:
    """Of the usable fits with skewed t, t, symmetric t and normal innovations the one whose median sigma is closest
    to the sample deviation, and how many were usable. The mean is AR(1) where Ljung-Box rejects white noise and any
    of those fits is usable, else constant."""
    for mean in ("ar", "constant") if ljung_box(r)[1] <= 0.05 else ("constant",):
        fits = [fit(r, Spec("gjr", mean, d, a), errors=errors) for d, a in CASCADE]
        fits = [f for f in fits if usable(f, r)]
        if fits:
            return min(fits, key=lambda f: abs(float(np.median(f.sigma)) - float(r.std(ddof=1)))), len(fits)
    return None, 0


def gjr_fit_panel(returns: DataFrame, least: int = 1000, column: str = "ret") -> DataFrame:
    """One row a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("date")[column].dropna().to_numpy(float)
        out = {"series_id": pdf["series_id"].iloc[0], "n": len(r)}
        if len(r) < least:
            return _row(GJR, out | {"status": "too short"})
        if zero_run_excess(r, least_share=2):
            return _row(GJR, out | {"status": "stale zeros"})
        f, usable_ = gjr_cascade(r)
        if f is None:
            return _row(GJR, out | {"status": "no usable fit", "candidates": 0})
        found = {"mean": f.spec.mean, "density": f.spec.density, "asymmetric": f.spec.asymmetric, "gamma": 0.0, "phi": 0.0, "loglik": f.loglik, "persistence": f.persistence, "candidates": usable_, "sigma_next": f.sigma_next}
        return _row(GJR, out | found | f.params | {"status": "ok" if f.converged else "not converged"})

    return returns.groupBy("series_id").applyInPandas(run, GJR)
