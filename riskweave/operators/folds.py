"""Path-dependent folds along a series, one series a task.

`applyInPandas` runs the series in parallel and each of them in linear time; this is for steps that don't compose
(a threshold on the state itself, an exponential of it). The filters whose steps do compose are in `scans` and split a
series; their plain steps are here. A step is a function (state, row) -> (state, outputs), which streaming reuses.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import so_far
from .scans import anti_chattering, arma_residuals, ewma_vol, gjr_filter, hamilton_filter, hamilton_states

__all__ = ["anti_chattering", "arma_residuals", "ewma_vol", "gjr_filter", "hamilton_filter", "hamilton_states"]

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def fold(df: DataFrame, inputs: list[str], start: Callable[[pd.DataFrame], Any] | Any, step: Step, outputs: str, keys: list[str] | None = None, order: str = "date") -> DataFrame:
    """Run `step` along each key's rows in order; adds the columns of `outputs` ("name type, ...")."""
    keys = keys or ["series_id"]
    names = [o.split()[0] for o in outputs.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = start(pdf) if callable(start) else start
        rows = []
        for values in zip(*(pdf[c].tolist() for c in inputs)):
            state, out = step(state, values)
            rows.append(out)
        for k, name in enumerate(names):
            pdf[name] = [r[k] for r in rows]
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + outputs
    return df.groupBy(*keys).applyInPandas(run, schema)


def hysteresis(df: DataFrame, score: str, on: float, off: float, name: str = "active") -> DataFrame:
    """On above `on`, off below `off`, held between. The thresholds don't overlap, so the state is the last
    crossing: one window, no fold."""
    crossing = F.when(F.col(score) > on, True).when(F.col(score) < off, False)
    return df.withColumn(name, F.coalesce(F.last(crossing, ignorenulls=True).over(so_far()), F.lit(False)))


def confirmed_step(enter: float, leave: float, confirm: int, dwell: int, partial: float) -> Step:
    """Two-threshold regime with confirmation and dwell. State: (stressed, days in the state, days in a row
    above `enter`, days in a row below `leave`). Without an exogenous confirmation stress counts at `partial`."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        stressed, days, above, below = state
        p, confirms = row
        if p is None or p != p:
            raise ValueError("a regime probability is missing")
        above = above + 1 if p > enter else 0
        below = below + 1 if p < leave else 0
        turn = (below if stressed else above) >= confirm and days >= dwell
        stressed, days = stressed != turn, 1 if turn else days + 1
        return (stressed, days, above, below), (stressed, days, 0.0 if not stressed else 1.0 if confirms else partial)

    return step


def smoothing_step(alpha: float) -> Step:
    """Exponential smoothing of row[0], executed only when it has moved more than row[1] from what is held."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        raw, band = row
        if state is None:
            return (raw, raw), (raw, raw)
        smooth = alpha * raw + (1 - alpha) * state[0]
        held = smooth if abs(smooth - state[1]) > band else state[1]
        return (smooth, held), (smooth, held)

    return step


def smooth_and_hold(df: DataFrame, raw: str, alpha: float = 0.3, band: Column | float = 0.05, keys: list[str] | None = None) -> DataFrame:
    banded = df.withColumn("band", band if isinstance(band, Column) else F.lit(float(band)))
    return fold(banded, [raw, "band"], None, smoothing_step(alpha), "smooth double, executed double", keys)


def ewma_step(decay: float) -> Step:
    """The variance before the row's return, then updated with it."""

    def step(var: float, row: tuple) -> tuple[float, tuple]:
        return decay * var + (1 - decay) * row[0] ** 2, (math.sqrt(var),)

    return step


def gjr_step(omega: float, alpha: float, gamma: float, beta: float) -> Step:
    def step(var: float, row: tuple) -> tuple[float, tuple]:
        e = row[0]
        return omega + (alpha + gamma * (e < 0)) * e * e + beta * var, (math.sqrt(var),)

    return step


def egarch_step(omega: float, alpha: float, gamma: float, beta: float, mean_abs: float) -> Step:
    def step(log_var: float, row: tuple) -> tuple[float, tuple]:
        sigma = math.exp(log_var / 2)
        e = row[0] / sigma
        return omega + alpha * (abs(e) - mean_abs) + gamma * e + beta * log_var, (sigma,)

    return step


def egarch_filter(residuals: DataFrame, omega: float, alpha: float, gamma: float, beta: float, first_log_var: float, mean_abs: float = math.sqrt(2 / math.pi), column: str = "ret") -> DataFrame:
    return fold(residuals, [column], first_log_var, egarch_step(omega, alpha, gamma, beta, mean_abs), "sigma double")


def arma_step(const: float, phi: float, theta: float) -> Step:
    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        r = row[0]
        e = r - const - (phi * state[0] + theta * state[1] if state else 0.0)
        return (r, e), (e,)

    return step


def hamilton_step(stay: tuple[float, ...], mean: tuple[float, ...], sd: tuple[float, ...]) -> Step:
    """Filtered probabilities of a two-state Markov chain with normal observations."""
    p00, p11 = stay

    def step(prob: float, row: tuple) -> tuple[float, tuple]:
        x = row[0]
        prior1 = prob * p11 + (1 - prob) * (1 - p00)
        like = [math.exp(-0.5 * ((x - m) / s) ** 2) / s for m, s in zip(mean, sd)]
        top, low = prior1 * like[1], (1 - prior1) * like[0]
        post = top / (top + low) if top + low > 0 else prior1
        return post, (post,)

    return step


def kim_smoother(filtered: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Smoothed probabilities from filtered ones, both (time x state)."""
    out = filtered.copy()
    for t in range(len(out) - 2, -1, -1):
        prior = filtered[t] @ transition
        out[t] = filtered[t] * (transition @ (out[t + 1] / np.maximum(prior, 1e-300)))
        out[t] /= out[t].sum()
    return out


def replay(step: Step, start: Any, rows: Iterable[tuple]) -> list[tuple]:
    """The plain fold, for tests and streaming."""
    out = []
    for row in rows:
        start, o = step(start, row)
        out.append(o)
    return out
