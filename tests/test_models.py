"""Fitted models: recovered parameters, gates, diagnostics, regimes, simulation."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskweave.functions import dist
from riskweave.operators import calendar as cal
from riskweave.operators import diagnostics, folds, models, rolling, stats, volatility
from riskweave.operators.volatility import MEAN_ABS, Spec

DAY = dt.date(2010, 1, 1)


def frame(spark, **series):
    rows = [(name, DAY + dt.timedelta(i), float(v)) for name, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, ret double")


def truths(seed):
    """True parameters of a GJR path, an EGARCH path and a chain of two regimes."""
    draw = np.random.default_rng(seed).uniform
    gjr = {"omega": draw(3e-6, 6e-6), "alpha": draw(0.02, 0.04), "gamma": draw(0.13, 0.19), "beta": draw(0.79, 0.83)}
    egarch = {"omega": -9.5 * 0.08, "alpha": draw(0.2, 0.26), "gamma": draw(-0.2, -0.16), "beta": 0.92, "nu": draw(7, 11)}
    chain = {"stay": (draw(0.95, 0.98), draw(0.92, 0.95)), "mean": (draw(-1.4, -0.9), draw(0.5, 1.1)), "sd": (draw(0.18, 0.24), draw(0.28, 0.36))}
    return gjr, egarch, chain


GJR, EGARCH, CHAIN = truths(71)


def gjr_path(n, seed, omega=GJR["omega"], alpha=GJR["alpha"], gamma=GJR["gamma"], beta=GJR["beta"], nu=None, phi=0.0):
    rng = np.random.default_rng(seed)
    v, last, out = omega / (1 - alpha - gamma / 2 - beta), 0.0, []
    for _ in range(n):
        z = rng.standard_normal() if nu is None else rng.standard_t(nu) * math.sqrt((nu - 2) / nu)
        e = math.sqrt(v) * z
        last = phi * last + e
        out.append(last)
        v = omega + (alpha + gamma * (e < 0)) * e * e + beta * v
    return np.array(out)


def egarch_path(n, seed, omega=EGARCH["omega"], alpha=EGARCH["alpha"], gamma=EGARCH["gamma"], beta=EGARCH["beta"], nu=EGARCH["nu"]):
    rng = np.random.default_rng(seed)
    log_v, out = omega / (1 - beta), []
    for _ in range(n):
        z = rng.standard_t(nu) * math.sqrt((nu - 2) / nu)
        out.append(math.exp(log_v / 2) * z)
        log_v = omega + alpha * (abs(z) - MEAN_ABS) + gamma * z + beta * log_v
    return np.array(out)


# --- volatility ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("nu, truth", [(None, 71), (5.5, 72)])
def test_gjr_recovers_its_parameters(nu, truth):
    own = truths(truth)[0]
    f = volatility.fit(gjr_path(5000, 1, **own, nu=nu), Spec("gjr", "constant", "t" if nu else "normal"))
    assert f.converged and all(abs(f[name] - own[name]) < 0.06 for name in ("alpha", "gamma", "beta"))
    assert nu is None or abs(f["nu"] - nu) < 1.5
    for name in ("beta", "gamma"):
        assert abs(f[name] - own[name]) < 4 * f.errors[name] and f.errors[name] < 0.08


def test_egarch_recovers_its_parameters():
    f = volatility.fit(egarch_path(5000, 2), Spec("egarch", "constant", "t"))
    assert abs(f["beta"] - EGARCH["beta"]) < 0.03 and abs(f["gamma"] - EGARCH["gamma"]) < 0.05 and abs(f["alpha"] - EGARCH["alpha"]) < 0.06 and f.p_value("gamma") < 1e-3
    assert f.half_life == pytest.approx(math.log(0.5) / math.log(f["beta"]))


def test_arma_mean_is_recovered():
    e = gjr_path(5000, 3)
    r = [e[0]]
    for t in range(1, len(e)):
        r.append(0.6 * r[-1] - 0.3 * e[t - 1] + e[t])
    f = volatility.fit(np.array(r), Spec("gjr", "arma"), errors=False)
    assert abs(f["phi"] - 0.6) < 0.08 and abs(f["theta"] + 0.3) < 0.09


def test_scale_does_not_matter():
    r = gjr_path(1500, 4)
    a, b = volatility.fit(r, Spec("gjr"), errors=False), volatility.fit(100 * r + 3, Spec("gjr"), errors=False)
    assert b["alpha"] == pytest.approx(a["alpha"], abs=1e-4) and b["omega"] == pytest.approx(1e4 * a["omega"], rel=1e-2) and b["const"] == pytest.approx(100 * a["const"] + 3, abs=1e-3)
    assert b.loglik == pytest.approx(a.loglik - len(r) * math.log(100), abs=1e-3)


def test_fit_is_the_filter_of_its_parameters(spark):
    r = gjr_path(800, 5)
    f = volatility.fit(r, Spec("gjr"), errors=False)
    s = folds.gjr_filter(frame(spark, s=r - f["const"]), f["omega"], f["alpha"], f["gamma"], f["beta"], float(r.var(ddof=1)))
    assert [x.sigma for x in s.orderBy("date").collect()] == pytest.approx(f.sigma.tolist())


def test_cascade_takes_the_fit_nearest_to_the_deviation():
    r = gjr_path(1500, 6, nu=5)
    f, n = volatility.gjr_cascade(r)
    fits = [volatility.fit(r, Spec("gjr", f.spec.mean, d, a), errors=False) for d, a in volatility.CASCADE]
    gap = lambda x: abs(np.median(x.sigma) - r.std(ddof=1))
    assert n == 4 and gap(f) == pytest.approx(min(map(gap, fits)), rel=1e-6)


def test_panel_says_what_is_wrong(spark):
    good, stale = egarch_path(1500, 7), egarch_path(1500, 8)
    stale[100:112] = 0
    rng = np.random.default_rng(9)
    fits = {r.series_id: r for r in volatility.egarch_fit_panel(frame(spark, good=good, short=good[:300], stale=stale, flipped=-good), least=1000).collect()}
    assert fits["good"].status == "ok" and fits["good"].leverage_confirmed and fits["good"].lb_p > 0.05 and fits["good"].symmetric_loglik is None
    assert fits["short"].status == "too short" and fits["stale"].status == "stale zeros" and fits["flipped"].status == "gamma has the wrong sign"
    table = volatility.ranked_panel(spark.createDataFrame([("a",), ("b",), ("c",)], "series_id string"), {"b": 1, "a": 2}).collect()
    assert [r.series_id for r in table] == ["b", "a", "c"]
    with pytest.raises(PySparkException, match="not valid"):
        volatility.require_ok(spark.createDataFrame([("a", "too short")], "series_id string, status string")).collect()
    with pytest.raises(ValueError):
        volatility.egarch_model(rng.normal(size=1200), densities=("normal",))


def test_autocorrelated_returns_escalate_the_mean():
    e = egarch_path(2500, 10)
    r = e.copy()
    for t in range(1, len(r)):
        r[t] = 0.8 * r[t - 1] + e[t] - 0.45 * e[t - 1]
    out, f = volatility.egarch_model(r, densities=("t",))
    assert out["mean"] == "arma" and out["lb_p"] > 0.05 and out["matrix_pricing"]


def test_symmetric_comparison_where_there_is_no_asymmetry():
    out, _ = volatility.egarch_model(egarch_path(1500, 11, gamma=0.0), densities=("t",))
    assert out["gamma_p"] > 0.05 and out["symmetric_loglik"] <= out["loglik"] + 1e-3 and not out["leverage_confirmed"]


def test_parameter_table_and_forecast(spark):
    df = frame(spark, s=egarch_path(1200, 12))
    rows = {r.name: r for r in volatility.egarch_parameters(df, Spec("egarch", "constant", "t")).collect()}
    assert set(rows) == {"const", "omega", "alpha", "gamma", "beta", "nu"} and rows["beta"].t_stat == pytest.approx(rows["beta"].value / rows["beta"].std_err)
    ahead = {r.horizon: r for r in volatility.egarch_forecast(df, (1, 22), 2000, spec=Spec("egarch", "constant", "t")).collect()}
    f = volatility.fit(egarch_path(1200, 12), Spec("egarch", "constant", "t"), errors=False)
    assert ahead[1].variance == pytest.approx(f.var[-1], rel=1e-6) and ahead[22].volatility == pytest.approx(math.sqrt(ahead[22].variance))


def test_conditional_volatility_is_the_fits_path(spark):
    r = egarch_path(900, 32)
    rows = volatility.conditional_volatility(frame(spark, s=r)).orderBy("date").collect()
    f = volatility.fit(r, Spec("egarch", "constant", "t"), errors=False)
    assert [x.sigma for x in rows] == pytest.approx(f.sigma.tolist()) and [x.z for x in rows] == pytest.approx(f.z.tolist())


def test_layers(spark):
    level = np.cumsum(-egarch_path(900, 13)) + 5
    walk = np.cumsum(level)
    levels = frame(spark, fine=level, short=level[:60], integrated=walk).withColumnRenamed("ret", "value")
    rows = {r.series_id: r for r in volatility.layered_egarch(levels).collect()}
    assert rows["fine"].status == "ok" and rows["fine"].may_originate and rows["fine"].adf_p < 0.05
    assert rows["short"].status == "too short" and rows["integrated"].status == "changes are not stationary"
    fired = spark.createDataFrame([(1, True), (2, False)], "i int, fired boolean")
    assert [r.i for r in volatility.originated(fired, volatility.PRIMARY).collect()] == [1]
    with pytest.raises(ValueError):
        volatility.originated(fired, "daily_vix_only")


# --- simulation ------------------------------------------------------------------------------------------


def test_fhs_and_portfolio(spark):
    a, b = gjr_path(1100, 14), gjr_path(1100, 15)
    rows = models.fhs_var_es(frame(spark, a=a, short=b[:200]), draws=4000).collect()
    own = {r.alpha: r for r in rows if r.series_id == "a"}
    assert 0 < own[0.975].var < own[0.99].var and own[0.99].es >= own[0.99].var and {r.status for r in rows if r.series_id == "short"} == {"too short"}
    f = volatility.gjr_cascade(a)[0]
    z = models.scaled_residuals(f)
    expected = -(f.mean_next(a[-1]) + f.sigma_next * np.quantile(z, 0.025))
    assert own[0.975].var == pytest.approx(expected, rel=0.1)
    port = models.portfolio_fhs(frame(spark, a=a, b=b), {"a": 0.5, "b": 0.5}, draws=3000).collect()
    assert len(port) == 2 and all(r.es >= r.var > 0 for r in port)


def test_copula_route_over_a_horizon(spark):
    rng = np.random.default_rng(16)
    a = gjr_path(1100, 17)
    b = 0.7 * a + 0.7 * rng.permutation(a)
    one, five = (models.tcopula_var(frame(spark, a=a, b=b), {"a": 0.5, "b": 0.5}, horizon=h, draws=3000).first() for h in (1, 5))
    assert one.es >= one.var > 0 and one.var < five.var < 5 * one.var and 0.5 < one.rho < 0.9
    with pytest.raises(ValueError):
        models.tcopula_var(frame(spark, a=a), {"a": 1.0})


def test_var_es_of_too_few_draws(spark):
    with pytest.raises(PySparkException, match="too few"):
        models.var_es_of(frame(spark, s=range(9))).collect()


def test_expanding_quantile_is_the_percentile_so_far(spark):
    rng = np.random.default_rng(18)
    x = rng.normal(size=120).round(1)
    for share, current in ((0.5, True), (0.05, False), (0.9, True)):
        got = [r.q for r in rolling.expanding_quantile(frame(spark, s=x), "ret", share, "q", include_current=current, least=3).orderBy("date").collect()]
        want = [np.quantile(x[: i + current], share) if i + current >= 3 else None for i in range(len(x))]
        assert [g is None for g in got] == [w is None for w in want] and [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


def test_first_component_agrees_with_the_closed_form(spark):
    rng = np.random.default_rng(19)
    rows = [("p", DAY + dt.timedelta(i), float(a), float(0.6 * a + b), None if i == 30 else 1.0) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "series_id string, date date, a double, b double, c double")
    one = [r.pc1 for r in rolling.first_component(df, ["a", "b"], 20).orderBy("date").collect()]
    two = [r.pc1 for r in rolling.first_component_of_two(df, "a", "b", 20).orderBy("date").collect()]
    assert one[:19] == two[:19] == [None] * 19 and one[19:] == pytest.approx(two[19:])
    gap = [r.pc1 for r in rolling.first_component(df, ["a", "c"], 20, 15).orderBy("date").collect()]
    assert gap[30] is None and gap[31] is not None


# --- diagnostics -------------------------------------------------------------------------------------------


def test_pre_estimation_verdicts(spark):
    rng = np.random.default_rng(20)
    noise, ar = rng.normal(size=500), [0.0]
    for v in rng.normal(size=499):
        ar.append(0.65 * ar[-1] + v)
    jump = np.concatenate([rng.normal(size=300), 4 * rng.normal(size=300)])
    rows = {(r.series_id, r.code): r for r in diagnostics.pre_estimation(frame(spark, noise=noise, walk=noise.cumsum(), ar=ar, arch=gjr_path(1500, 21, alpha=0.2, beta=0.6), jump=jump)).collect()}
    assert rows["noise", "A1.joint"].status == "PASS" and rows["walk", "A1.joint"].status == "FAIL"
    assert rows["arch", "A2.ARCH_LM_5"].status == "PASS" and rows["noise", "A2.ARCH_LM_5"].status == "WARN"
    assert rows["ar", "A3.rho1"].status == "WARN" and rows["ar", "A3.LjungBox_10"].status == "WARN" and rows["noise", "A3.rho1"].status == "PASS"
    assert rows["noise", "A4.JarqueBera"].status == "PASS" and rows["jump", "A5.ICSS"].status == "WARN" and rows["jump", "A5.CUSUM"].status == "WARN" and rows["noise", "A5.ICSS"].status == "PASS"


def test_post_estimation_verdicts(spark):
    rows = {r.code: r for r in diagnostics.post_estimation(frame(spark, s=gjr_path(1500, 22, nu=6))).collect()}
    assert {c: r.status for c, r in rows.items() if c[:2] in ("B1", "B2", "B5")} == {c: "PASS" for c in rows if c[:2] in ("B1", "B2", "B5")}
    assert rows["B6.convergence"].status == "PASS" and rows["B6.restarts"].statistic is not None and rows["B4.KS"].status in ("PASS", "WARN")
    bad = frame(spark, s=gjr_path(1500, 23, alpha=0.25, beta=0.5)).withColumn("z", F.col("ret") * 50)
    left = {r.code: r.status for r in diagnostics.residual_checks(bad, "gjr", eps="ret").collect()}
    assert left["B2.LjungBox_z2"] == "FAIL" and left["B2.ARCH_LM"] == "FAIL"
    assert {r.code: r.status for r in diagnostics.residual_checks(bad, "gjr", eps=None).collect()}["B3.EngleNg"] == "FAIL"


def test_single_rows_of_the_suite():
    assert diagnostics.joint_status(0.01, 0.1) == "PASS" and diagnostics.joint_status(0.2, 0.01) == "FAIL" and diagnostics.joint_status(0.01, 0.01) == "WARN"
    assert diagnostics.stationarity_row("gjr", 1e-6, 0.05, 0.1, 0.85)[3] == "PASS" and diagnostics.stationarity_row("gjr", 1e-6, -0.01, 0.1, 0.85)[3] == "FAIL"
    assert diagnostics.stationarity_row("egarch", -1, 0.1, 0, 0.9995)[3] == "WARN" and diagnostics.stationarity_row("symmetric", 1e-6, 0.2, 0, 0.9)[3] == "FAIL"
    assert [r[3] for r in diagnostics.optimiser_rows(True, [1.0, 1.001, 1.002, 1.0, 1.0])] == ["PASS", "PASS"]
    assert [r[3] for r in diagnostics.optimiser_rows(False, [1.0, 2.0, 1.0, 1.0, 1.0])] == ["FAIL", "FAIL"] and diagnostics.optimiser_rows(True, None)[1][3] == "FAIL"


def test_distribution_rows_and_quantiles(spark):
    z = np.random.default_rng(24).standard_t(5, 2000) * math.sqrt(3 / 5)
    assert diagnostics.distribution_row(z, diagnostics.assumed_cdf("t", 5))[3] == "PASS"
    assert diagnostics.distribution_row(z, diagnostics.assumed_cdf("normal"))[3] == "WARN"
    pairs = diagnostics.quantile_pairs(frame(spark, s=z[:500]), "skewt", 5, 0.0, "ret").orderBy("place").collect()
    assert len(pairs) == 500 and pairs[249].assumed == pytest.approx(0, abs=0.01) and np.corrcoef([p.observed for p in pairs], [p.assumed for p in pairs])[0, 1] > 0.97


def test_p_values_of_odd_lags_and_distances(spark):
    rng = np.random.default_rng(25)
    x = rng.normal(size=300)
    got = stats.ljung_box(frame(spark, s=x), 5).first()
    assert (got.q, got.p_value) == pytest.approx(volatility.ljung_box(x, 5))
    u = spark.createDataFrame([("s", float(v)) for v in rng.random(400)], "series_id string, cdf double")
    assert 0.01 < stats.ks_distance(u).first().p_value <= 1
    assert stats.ks_distance(u.withColumn("cdf", F.col("cdf") ** 2)).first().p_value < 1e-6
    sb = stats.sign_bias(frame(spark, s=x).withColumn("z", F.col("ret")).withColumn("eps", F.col("ret"))).first()
    assert sb.df == 3 and sb.p_value == pytest.approx(dist.chi2_sf(sb.stat, 3))


# --- regimes -----------------------------------------------------------------------------------------------


def regimes(n, seed, stay=CHAIN["stay"], mean=CHAIN["mean"], sd=CHAIN["sd"]):
    rng = np.random.default_rng(seed)
    s, x, states = 0, [], []
    for _ in range(n):
        s = s if rng.random() < stay[s] else int((s + rng.integers(1, len(stay))) % len(stay))
        states.append(s)
        x.append(rng.normal(mean[s], sd[s]))
    return np.array(x), np.array(states)


def test_two_regimes_are_recovered(spark):
    x, states = regimes(900, 26)
    m = models.fit_markov(x)
    assert m["converged"] and m["mean"] == pytest.approx(CHAIN["mean"], abs=0.1) and np.diag(m["trans"]) == pytest.approx(CHAIN["stay"], abs=0.05)
    assert ((m["filtered"][:, 1] > 0.5) == (states == 1)).mean() > 0.97 and models.agree(m["restarts"])
    df = frame(spark, s=x).withColumnRenamed("ret", "log_rv")
    paths = models.markov_regime_fit(df, "log_rv")
    report = {r.regime: r for r in models.regime_report(df, "log_rv").collect()}
    assert report["stress"].expected_duration == pytest.approx(1 / (1 - m["trans"][1, 1])) and report["calm"].unconditional + report["stress"].unconditional == pytest.approx(1) and report["calm"].implied_rv < report["stress"].implied_rv
    day = (DAY + dt.timedelta(500)).isoformat()
    declared = folds.anti_chattering(paths.withColumn("confirms", F.lit(True)))
    assert models.state_lookup(declared, day).first().stressed == bool(states[500])
    with pytest.raises(PySparkException, match="not in the sample"):
        models.state_lookup(declared, "1999-01-01").collect()
    flat = lambda x, *_: {"filtered": np.full((len(x), 2), 0.5), "smoothed": np.full((len(x), 2), 0.5), "trans": np.eye(2) * 0.8 + 0.1, "converged": True, "restarts": [0.0]}
    assert models.markov_regime_fit(df, "log_rv", backend=flat).first().p_stress == 0.5
    seen, smooth = models.regime_lookup(paths, day).first(), models.regime_lookup(paths, day, "smoothed").first()
    assert seen.probability == pytest.approx(m["filtered"][500, 1]) and not seen.looks_ahead and smooth.looks_ahead
    with pytest.raises(PySparkException, match="not in the sample"):
        models.regime_lookup(paths, "1999-01-01").collect()
    with pytest.raises(ValueError):
        models.regime_lookup(paths, day, "other")
    with pytest.raises(PySparkException, match="need 500"):
        models.markov_regime_fit(df.limit(100), "log_rv").collect()


def test_denton_meets_the_means_with_the_least_change():
    draw = np.random.default_rng(33)
    indicator, c = draw.normal(size=60).cumsum(), np.kron(np.eye(6), np.full(10, 0.1))
    y = c @ indicator + draw.normal(size=6)
    out = models.denton(y, indicator, c)
    rough = lambda x: float((np.diff(x - indicator) ** 2).sum())
    assert c @ out == pytest.approx(y, abs=1e-6)
    free = np.linalg.svd(c)[2][6:]  # directions that leave the means as they are
    assert all(rough(out + 1e-2 * v) >= rough(out) - 1e-9 and rough(out - 1e-2 * v) >= rough(out) - 1e-9 for v in free)


def test_three_regimes_and_their_validity():
    x, _ = regimes(1500, 27, (0.97, 0.95, 0.95), (-3.0, -1.5, 0.0), (0.2, 0.2, 0.3))
    m = models.fit_markov(x, 3)
    assert m["mean"] == pytest.approx([-3, -1.5, 0], abs=0.15)
    assert models.economically_valid(models.stationary(m["trans"]), models.durations(m["trans"]))
    assert not models.economically_valid(np.array([0.5, 0.45, 0.05]), np.array([20, 20, 20.0])) and not models.economically_valid(np.array([0.4, 0.3, 0.3]), np.array([20, 5, 20.0]))


def test_stationary_shares_and_durations():
    p = np.array([[0.95, 0.05], [0.10, 0.90]])
    assert models.stationary(p) == pytest.approx([2 / 3, 1 / 3]) and models.durations(p) == pytest.approx([20, 10]) and np.isinf(models.durations(np.eye(2))).all()


def test_em_filter_is_the_hamilton_filter(spark):
    x, _ = regimes(300, 28)
    m = models.fit_markov(x, restarts=5, rounds=200)
    # the last round's filter starts from the smoothed first row; after some rows that no longer matters
    got = folds.replay(folds.hamilton_step((m["trans"][0, 0], m["trans"][1, 1]), tuple(m["mean"]), tuple(m["sd"])), 0.5, [(v,) for v in x])
    assert [g[0] for g in got][50:] == pytest.approx(m["filtered"][50:, 1].tolist(), abs=1e-4)
    three = folds.hamilton_states(frame(spark, s=x), "ret", ((m["trans"][0, 0], m["trans"][0, 1]), (m["trans"][1, 0], m["trans"][1, 1])), tuple(m["mean"]), tuple(m["sd"]), ("calm", "stress")).orderBy("date").collect()
    assert [r.stress for r in three][50:] == pytest.approx(m["filtered"][50:, 1].tolist(), abs=1e-4)
    smooth = folds.kim_smoother(m["filtered"], m["trans"])
    assert smooth.sum(axis=1) == pytest.approx(np.ones(300)) and smooth[-1] == pytest.approx(m["filtered"][-1])


# --- walk-forward and disaggregation -------------------------------------------------------------------------


def test_walk_forward_refits_see_only_the_past(spark):
    r = gjr_path(700, 29)
    df, spec = frame(spark, s=r), Spec("gjr")
    run = lambda x: models.walk_forward(frame(spark, s=x), cal.reestimation_dates(frame(spark, s=x), 500), models.fitted_estimate(spec), models.fitted_sigmas(spec), ("beta", "omega")).orderBy("date").collect()
    rows = run(r)
    first = rows[0].tau
    at = (first - DAY).days
    f = volatility.fit(r[:at], spec, errors=False)
    assert rows[0].beta == pytest.approx(f["beta"], abs=1e-6) and rows[0].sigma == pytest.approx(f.sigma_next, rel=1e-6)
    later = r.copy()
    later[at + 5 :] *= 3
    again = run(later)
    assert [x.sigma for x in again[:6]] == pytest.approx([x.sigma for x in rows[:6]]) and df.count() == 700


def test_chow_lin_asof_projects_what_is_not_published(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(366)]
    rng = np.random.default_rng(30)
    x = rng.normal(size=366).cumsum() / 10
    daily = spark.createDataFrame([("d", d, float(v)) for d, v in zip(days, x)], "series_id string, date date, ind double")
    month = pd.Series(x, index=pd.to_datetime(days)).resample("MS").mean()
    monthly = spark.createDataFrame([("m", m.date(), float(1 + 2 * v)) for m, v in month.items()], "series_id string, date date, value double")
    path = models.chow_lin_daily(daily, monthly, ["ind"], asof="2020-08-20")
    got = path.orderBy("date").collect()
    # June is published on 14 August, July not yet
    assert got[-1].date == dt.date(2020, 8, 20) and [r.projected for r in got] == [r.date >= dt.date(2020, 7, 1) for r in got]
    assert not got[0].looks_ahead and models.chow_lin_daily(daily, monthly, ["ind"]).first().looks_ahead
    error = cal.aggregation_error(path.where("NOT projected"), monthly).first()
    assert error.months == 6 and error.max_error < 1e-8


def test_asof_without_keys_is_the_last_value_before(spark):
    rng = np.random.default_rng(31)
    left = [(DAY + dt.timedelta(int(i)), float(i)) for i in sorted(rng.choice(900, 300, replace=False))]
    right = [(DAY + dt.timedelta(int(i)), None if i % 7 == 0 else float(-i)) for i in sorted(rng.choice(900, 25, replace=False)) if i > 40]
    got = cal.asof_join(spark.createDataFrame(left, "date date, v double"), spark.createDataFrame(right, "date date, w double"), ["w"]).orderBy("date").collect()
    want = [next((w for d, w in reversed(right) if d <= day), None) for day, _ in left]
    assert [(r.date, r.v) for r in got] == left and [r.w for r in got] == want
