import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyframe.functions import special
from surveyframe.models import contrasts as C
from surveyframe.models import diagnostics as D
from surveyframe.models import glm, mixed, smooth, sparse
from surveyframe.models.gram import ModelSpec, design_columns, fit_gaussian, gram, matrix, mean_weights, reference_grid
from surveyframe.operators.keys import join_on
from surveyframe.session import literal_frame

lgamma = np.vectorize(math.lgamma)


def simulated(family, seed=3, n=600, phi=2.0, effect=0.0, clusters=None):
    rng = np.random.default_rng(seed)
    cell = rng.integers(0, 2, n)
    x = rng.choice(np.linspace(-1.5, 1.5, 13), n)
    cl = rng.integers(0, clusters, n) if clusters else np.arange(n)
    u = rng.normal(0, effect, clusters)[cl] if clusters else 0.0
    mu = np.exp(np.where(cell == 0, 1.0, 1.6) + np.where(cell == 0, 0.3, -0.4) * x + u)
    if family == "poisson":
        y = rng.poisson(mu)
    else:
        size = phi if family == "nb2" else mu / phi
        y = rng.poisson(rng.gamma(size, mu / size))
    return [(f"c{c}", float(a), int(b), f"k{k}") for c, a, b, k in zip(cell, x, y, cl)]


def loglik(family, rows, coef, phi):
    total = 0.0
    for c, x, y, _ in rows:
        a, b = coef[c]
        mu = math.exp(a + b * x)
        if family == "poisson":
            total += y * math.log(mu) - mu - math.lgamma(y + 1)
            continue
        size = phi if family == "nb2" else mu / phi
        total += math.lgamma(y + size) - math.lgamma(size) - math.lgamma(y + 1) + size * math.log(size / (size + mu)) + y * math.log(mu / (size + mu))
    return total


@pytest.mark.parametrize("family", ["poisson", "nb1", "nb2"])
def test_fit_is_the_likelihood_maximum_and_errors_match_curvature(spark, family):
    rows = simulated(family)
    fit = glm.fit_cells(spark.createDataFrame(rows, "cell string, x double, y int, k string"), ["cell"], "y", "x", family)
    got = {r["cell"]: r for r in fit.coef.collect()}
    coef = {c: (r["a"], r["b"]) for c, r in got.items()}
    phi = got["c0"]["phi"]
    base = loglik(family, rows, coef, phi)
    assert fit.stats["converged"] and fit.stats["loglik"] == pytest.approx(base, abs=1e-6)
    theta = [*coef["c0"], *coef["c1"]] + ([] if family == "poisson" else [math.log(phi)])

    def at(t):
        return loglik(family, rows, {"c0": t[0:2], "c1": t[2:4]}, math.exp(t[4]) if len(t) > 4 else 1.0)

    h, p = 1e-4, len(theta)
    hessian = np.zeros((p, p))
    for i in range(p):
        step = np.eye(p)[i] * h
        assert abs(at(theta + step) - at(theta - step)) / (2 * h) < 1e-2
        for j in range(p):
            other = np.eye(p)[j] * h
            hessian[i, j] = (at(theta + step + other) - at(theta + step - other) - at(theta - step + other) + at(theta - step - other)) / (4 * h * h)
    want = np.sqrt(np.diag(np.linalg.inv(-hessian)))
    cov = {(r["term_i"], r["term_j"]): r["value"] for r in glm.covariance(fit).collect()}
    for i, term in enumerate(["c0:intercept", "c0:slope", "c1:intercept", "c1:slope"]):
        assert math.sqrt(cov[term, term]) == pytest.approx(want[i], rel=0.03 if family == "nb2" else 2e-3)


def test_closed_form_equals_iteration_and_empty_cell_is_flagged(spark):
    rows = [(r[0], r[2]) for r in simulated("poisson", n=80)] + [("zero", 0)] * 5
    df = spark.createDataFrame(rows, "cell string, y int")
    exact = {r["cell"]: r for r in glm.closed_form(df, ["cell"], "y").coef.collect()}
    fit = glm.fit_cells(df, ["cell"], "y")
    for r in fit.coef.collect():
        if r["cell"] == "zero":
            assert not r["definite"] and r["v00"] is None
        else:
            assert (r["a"], r["v00"]) == pytest.approx((exact[r["cell"]]["a"], exact[r["cell"]]["v00"]))
    assert fit.stats["converged"]


def test_one_flat_x_gives_a_level_without_slope(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 1.0, 5), ("b", 0.0, 1), ("b", 1.0, 4)], "cell string, x double, y int")
    got = {r["cell"]: r for r in glm.fit_cells(df, ["cell"], "y", "x").coef.collect()}
    assert got["a"]["b"] == 0.0 and got["a"]["a"] == pytest.approx(math.log(4)) and not got["a"]["definite"]
    assert got["b"]["b"] == pytest.approx(math.log(4))


def test_zero_inflation_recovers_its_share(spark):
    rng = np.random.default_rng(5)
    rows = [(c, x, 0 if rng.random() < 0.3 else y) for c, x, y, _ in simulated("poisson", n=1500)]
    fit = glm.fit_cells(spark.createDataFrame(rows, "cell string, x double, y int"), ["cell"], "y", "x", "poisson", zi_by=[])
    r = fit.coef.first()
    assert r["zi"] == pytest.approx(0.3, abs=0.05)
    pred = glm.predict(fit, spark.createDataFrame([("c0", 0.0)], "cell string, x double"), "x").first()
    assert pred["mean"] == pytest.approx((1 - r["zi"]) * pred["conditional_mean"]) and pred["lower"] < pred["conditional_mean"] < pred["upper"]


def test_models_by_key_equal_separate_fits(spark):
    rows = [("one", *r[:3]) for r in simulated("nb2", 1, 200)] + [("two", *r[:3]) for r in simulated("nb2", 2, 200, phi=5.0)]
    df = spark.createDataFrame(rows, "sp string, cell string, x double, y int")
    both = glm.fit_cells(df, ["sp", "cell"], "y", "x", "nb2", phi_by=["sp"]).coef
    alone = glm.fit_cells(df.where("sp = 'two'"), ["cell"], "y", "x", "nb2").coef
    a = both.where("sp = 'two'").orderBy("cell").select("a", "b", "phi").collect()
    b = alone.orderBy("cell").select("a", "b", "phi").collect()
    assert [tuple(r) for r in a] == [pytest.approx(tuple(r), rel=1e-5) for r in b]


def test_dispersion_profile_equals_joint_fit(spark):
    df = spark.createDataFrame(simulated("nb2", n=500), "cell string, x double, y int, k string")
    fit = glm.fit_cells(df, ["cell"], "y", "x", "nb2")
    rows = glm.fitted_rows(df, fit, x="x").select("mu", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("n"))
    assert glm.fit_dispersion(rows, "nb2").first()["phi"] == pytest.approx(fit.coef.first()["phi"], rel=1e-5)


def test_mixed_is_the_marginal_maximum(spark):
    rows = simulated("poisson", n=400, effect=0.6, clusters=60)
    df = spark.createDataFrame(rows, "cell string, x double, y int, k string")
    fit = mixed.fit_mixed(df, ["cell"], "y", "k", "x", "poisson", max_iterations=25)
    coef = {r["cell"]: (r["a"], r["b"]) for r in fit.coef.collect()}
    u = np.linspace(-6, 6, 6001)

    def marginal(sigma):
        total = 0.0
        for k in {r[3] for r in rows}:
            mine = [r for r in rows if r[3] == k]
            ll = sum(y * (coef[c][0] + coef[c][1] * x + u) - np.exp(coef[c][0] + coef[c][1] * x + u) - math.lgamma(y + 1) for c, x, y, _ in mine)
            ll = ll - 0.5 * (u / sigma) ** 2 - math.log(sigma) - 0.5 * math.log(2 * math.pi)
            total += math.log(np.exp(ll - ll.max()).sum() * (u[1] - u[0])) + ll.max()
        return total

    s = fit.stats["sigma"]
    assert fit.stats["converged"] and s == pytest.approx(0.6, abs=0.2)
    assert fit.stats["loglik"] == pytest.approx(marginal(s), abs=0.01)
    assert marginal(s) > marginal(s * 1.1) - 1e-3 and marginal(s) > marginal(s * 0.9) - 1e-3
    assert fit.vcov.where("term_i = 'c0:slope' and term_j = 'c0:slope'").first()["value"] > 0


def test_crossed_effects_shrink_towards_zero(spark):
    rng = np.random.default_rng(8)
    level, cluster = rng.normal(0, 0.8, 6), rng.normal(0, 0.4, 50)
    rows = [(f"s{i}", f"k{j}", "c", int(rng.poisson(math.exp(1.5 + level[i] + cluster[j])))) for i in range(6) for j in range(50)]
    fit = mixed.fit_crossed(spark.createDataFrame(rows, "sp string, k string, cell string, y int"), ["cell"], "y", "k", "sp", "poisson")
    got = np.array([r["m"] for r in fit.levels.orderBy("level").collect()])
    assert np.corrcoef(got, level)[0, 1] > 0.98
    assert fit.stats["sigma"] == pytest.approx(0.4, abs=0.15)


def _clustered(seed, n_clusters, phi=2.0, zero=0.15, sigma=0.6):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n_clusters):
        u, t = rng.normal() * sigma, rng.uniform(-1, 1)
        for g, (a, b) in {"x": (1.2, 0.4), "y": (0.6, -0.5)}.items():
            mu = math.exp(a + b * t + u)
            out.append((f"c{c}", g, float(t), 0 if rng.random() < zero else int(rng.poisson(rng.gamma(phi, mu / phi)))))
    return out


def _second_differences(f, at, h=1e-3):
    n, e = len(at), np.eye(len(at)) * h
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = (f(at + e[i] + e[j]) - f(at + e[i] - e[j]) - f(at - e[i] + e[j]) + f(at - e[i] - e[j])) / (4 * h * h)
    return out


def test_mixed_errors_equal_second_differences(spark):
    """Lines, dispersion, zero shares and the effects' deviation: all in one covariance, read like any other fit."""
    rows = _clustered(1, 150)
    df = spark.createDataFrame(rows, "k string, g string, t double, y int")
    fit = mixed.fit_mixed(df, ["g"], "y", "k", "t", "nb2", zi_by=["g"], nodes=11)
    coef = {r["g"]: r for r in fit.coef.collect()}
    logit = lambda p: math.log(p / (1 - p))
    names = ["x:intercept", "x:slope", "y:intercept", "y:slope", "log_phi", "logit_zi:x", "logit_zi:y", "log_sigma"]
    at = [coef["x"]["a"], coef["x"]["b"], coef["y"]["a"], coef["y"]["b"], math.log(coef["x"]["phi"]), logit(coef["x"]["zi"]), logit(coef["y"]["zi"]), math.log(fit.stats["sigma"])]
    nodes, weights = np.polynomial.hermite_e.hermegauss(50)
    which = np.array([r[1] == "y" for r in rows], dtype=int)
    t, y, k = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.unique([r[0] for r in rows], return_inverse=True)[1]
    lg = np.vectorize(math.lgamma)

    def marginal(p):
        phi, zi = math.exp(p[4]), 1 / (1 + np.exp(-p[5:7]))[which][:, None]
        eta = (p[0:4:2][which] + p[1:4:2][which] * t)[:, None] + math.exp(p[7]) * nodes[None]
        ll = (lg(y + phi) - math.lgamma(phi) - lg(y + 1))[:, None] + phi * math.log(phi) + y[:, None] * eta - (y[:, None] + phi) * np.log(np.exp(eta) + phi)
        ll = np.where(y[:, None] == 0, np.log(zi + (1 - zi) * np.exp(ll)), np.log1p(-zi) + ll)
        per = np.zeros((k.max() + 1, 50))
        np.add.at(per, k, ll)
        top = per.max(axis=1, keepdims=True)
        return float((np.log((np.exp(per - top) * weights).sum(axis=1) / math.sqrt(2 * math.pi)) + top[:, 0]).sum())

    assert fit.stats["loglik"] == pytest.approx(marginal(np.array(at)), abs=1e-4)
    want = np.linalg.inv(-_second_differences(marginal, np.array(at)))
    got = {(r["term_i"], r["term_j"]): r["value"] for r in fit.vcov.collect()}
    assert set(got) == {(a, b) for a in names for b in names}
    assert np.array([[got[a, b] for b in names] for a in names]) == pytest.approx(want, rel=1e-3, abs=1e-4)
    frame = {r["term"]: r for r in glm.coefficients(fit).collect()}
    assert frame["y:slope"]["se"] == pytest.approx(math.sqrt(want[3, 3]), rel=1e-3)
    assert glm.covariance(fit).where("term_i = 'x:slope' and term_j = 'log_sigma'").count() == 1
    apart = C.contrast(glm.coefficients(fit), glm.covariance(fit), C.cell_weights(glm.coefficients(fit), "slope", [], {"g": ("x", "y")}), []).first()
    assert apart["se"] == pytest.approx(math.sqrt(want[1, 1] + want[3, 3] - 2 * want[1, 3]), rel=1e-3)
    band = glm.predict(fit, spark.createDataFrame([("x", 0.5)], "g string, t double"), "t").first()
    assert band["link_se"] == pytest.approx(math.sqrt(want[0, 0] + want[0, 1] + 0.25 * want[1, 1]), rel=1e-3)


def test_mixed_models_by_key_and_without_effects(spark):
    rows = [("one", *r) for r in _clustered(2, 60, zero=0.0)] + [("two", *r) for r in _clustered(3, 60, zero=0.0, sigma=0.0, phi=50.0)]
    rows += [("two", f"c{k}", "empty", 0.1 * k, 0) for k in range(5)]
    df = spark.createDataFrame(rows, "sp string, k string, g string, t double, y int")
    both = mixed.fit_mixed(df, ["sp", "g"], "y", "k", None, "nb2", model_by=["sp"])
    alone = mixed.fit_mixed(df.where("sp = 'one'"), ["g"], "y", "k", None, "nb2")
    a = both.coef.where("sp = 'one'").orderBy("g").select("a", "phi", "v00").collect()
    assert [tuple(r) for r in a] == [pytest.approx(tuple(r), rel=1e-3) for r in alone.coef.orderBy("g").select("a", "phi", "v00").collect()]
    per = {r["model"]: r for r in both.models.collect()}
    assert per["one"]["sigma"] == pytest.approx(alone.stats["sigma"], rel=1e-3) and per["two"]["sigma"] < 0.3
    assert per["one"]["loglik"] == pytest.approx(alone.stats["loglik"], abs=1e-3)
    none = both.coef.where("g = 'empty'").first()
    assert none["v00"] is None and not none["definite"]
    terms = {(r["model"], r["term"]): r["estimate"] for r in glm.coefficients(both, ["sp"]).collect()}
    assert terms["two", "empty:intercept"] is None and ("one", "x:intercept") in terms


def test_crossed_equals_a_dense_solve(spark):
    rng = np.random.default_rng(3)
    level = rng.normal(0, 0.7, 5)
    rows = []
    for c in range(40):
        u = rng.normal() * 0.6
        for k in range(5):
            for g in ("j", "a"):
                mu = math.exp(0.8 + (0.3 if g == "j" else 0) + u + level[k])
                rows.append((f"c{c:02d}", f"s{k}", g, int(rng.poisson(rng.gamma(3.0, mu / 3.0)))))
    fit = mixed.fit_crossed(spark.createDataFrame(rows, "k string, sp string, g string, y int"), ["g"], "y", "k", "sp", "nb2")
    s, coef = fit.stats, {r["g"]: r for r in fit.coef.collect()}
    assert s["iterations"] < 30
    cells = ["a", "j"]
    x = np.zeros((len(rows), 2 + 5 + 40))
    for i, (c, k, g, _) in enumerate(rows):
        x[i, cells.index(g)] = x[i, 2 + int(k[1:])] = x[i, 7 + int(c[1:])] = 1
    y, phi = np.array([r[3] for r in rows]), coef["a"]["phi"]
    hold = np.concatenate([np.zeros(2), np.full(5, s["sigma_level"] ** -2), np.full(40, s["sigma"] ** -2)])
    theta = np.zeros(47)
    for _ in range(60):
        mu = np.exp(x @ theta)
        info = x.T @ (x * ((y + phi) * mu * phi / (mu + phi) ** 2)[:, None]) + np.diag(hold)
        step = np.linalg.solve(info, x.T @ (phi * (y - mu) / (mu + phi)) - hold * theta)
        theta = theta + step * min(1.0, 1.0 / np.abs(step).max())
    cov = np.linalg.inv(info)
    assert [coef[g]["a"] for g in cells] == pytest.approx(theta[:2], abs=1e-3)
    assert [math.sqrt(coef[g]["v00"]) for g in cells] == pytest.approx(np.sqrt(np.diag(cov))[:2], rel=1e-3)
    assert [r["m"] for r in fit.levels.orderBy("level").collect()] == pytest.approx(theta[2:7], abs=1e-3)
    assert [r["m"] for r in fit.clusters.orderBy("cluster").collect()] == pytest.approx(theta[7:], abs=1e-3)
    lg = np.vectorize(math.lgamma)
    ll = (lg(y + phi) - math.lgamma(phi) - lg(y + 1) + phi * math.log(phi) + y * np.log(mu) - (y + phi) * np.log(mu + phi)).sum()
    laplace = ll - 0.5 * (hold * theta**2).sum() - 5 * math.log(s["sigma_level"]) - 40 * math.log(s["sigma"]) - 0.5 * np.linalg.slogdet(info[2:, 2:])[1]
    assert s["loglik"] == pytest.approx(laplace, abs=1e-2)
    off = fit.vcov.where("term_i = 'a:intercept' and term_j = 'j:intercept'").first()["value"]
    assert off == pytest.approx(cov[0, 1], rel=1e-3)


def test_laplace_of_one_factor_is_near_quadrature(spark):
    rows = [(c, "one", g, y) for c, g, _, y in _clustered(5, 60, zero=0.0)]
    df = spark.createDataFrame(rows, "k string, sp string, g string, y int")
    crossed = mixed.fit_crossed(df, ["g"], "y", "k", "sp", "poisson")
    one = mixed.fit_mixed(df, ["g"], "y", "k", None, "poisson")
    assert crossed.stats["sigma"] == pytest.approx(one.stats["sigma"], rel=0.1)
    assert crossed.stats["loglik"] == pytest.approx(one.stats["loglik"], abs=2.0)


def test_sandwich_equals_dense_formula(spark):
    rows = simulated("poisson", n=200, clusters=20)
    df = spark.createDataFrame(rows, "cell string, x double, y int, k string")
    fit = glm.fit_cells(df, ["cell"], "y", "x")
    got = {(r["term_i"], r["term_j"]): r["value"] for r in mixed.sandwich(df, fit, "k", "y", "x").collect()}
    coef = {r["cell"]: (r["a"], r["b"]) for r in fit.coef.collect()}
    info, scores = np.zeros((4, 4)), {}
    for c, x, y, k in rows:
        mu = math.exp(coef[c][0] + coef[c][1] * x)
        v = np.zeros(4)
        v[2 * int(c[1])], v[2 * int(c[1]) + 1] = 1, x
        info += mu * np.outer(v, v)
        scores[k] = scores.get(k, np.zeros(4)) + (y - mu) * v
    bread = np.linalg.inv(info)
    want = bread @ sum(np.outer(s, s) for s in scores.values()) @ bread
    assert got["c0:slope", "c1:slope"] == pytest.approx(want[1, 3], rel=1e-6)
    assert got["c1:intercept", "c1:intercept"] == pytest.approx(want[2, 2], rel=1e-6)


def test_smooth_follows_a_bend_and_stays_a_line_on_a_line(spark):
    rng = np.random.default_rng(2)
    x = np.linspace(-1.5, 1.5, 400)
    # The bend sits at the upper third of x, where the basis has a knot.
    bend = np.exp(2 - 0.5 * x + 2.0 * np.maximum(x - 0.5, 0))
    rows = [("bend", float(a), int(rng.poisson(m))) for a, m in zip(x, bend)] + [("line", float(a), int(rng.poisson(math.exp(2 + 0.4 * a)))) for a in x]
    df = spark.createDataFrame(rows, "cell string, x double, y int")
    start = glm.fit_cells(df, ["cell"], "y", "x")
    coef, knots = smooth.fit_smooth(df, ["cell"], "x", "y", start)
    edf = {r["cell"]: r["edf"] for r in coef.collect()}
    assert edf["bend"] > 2.5 and all(2 <= e <= 4 for e in edf.values())
    truth = {"bend": lambda v: math.exp(2 - 0.5 * v + 2.0 * max(v - 0.5, 0)), "line": lambda v: math.exp(2 + 0.4 * v)}
    grid = spark.createDataFrame([(c, v) for c in truth for v in (-1.0, 0.0, 1.0)], "cell string, x double")
    for r in smooth.predict_smooth(coef, knots, grid, ["cell"], "x").collect():
        assert r["smooth_mean"] == pytest.approx(truth[r["cell"]](r["x"]), rel=0.2)
    line = [r["smooth_mean"] for r in smooth.predict_smooth(coef, knots, grid.where("cell = 'line'"), ["cell"], "x").orderBy("x").collect()]
    assert line == sorted(line)


# --- linear parts ------------------------------------------------------------------------


def test_gram_paths_agree_and_gaussian_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    rows = [(rng.choice(["a", "b"]), rng.choice(["u", "v", "w"]), float(x)) for x in rng.normal(size=120)]
    rows = [(*r, 1.0 + (r[0] == "b") * 0.5 + 0.3 * r[2] + float(rng.normal()) * (2 if r[0] == "b" else 1)) for r in rows]
    df = spark.createDataFrame([tuple(map(lambda v: str(v) if isinstance(v, str) else v, r)) for r in rows], "f string, g string, x double, y double")
    spec = ModelSpec([("f",), ("g",), ("x",), ("f", "g"), ("f", "x"), ("g", "x"), ("f", "g", "x")], {"f": ["a", "b"], "g": ["u", "v", "w"]})
    cols = dict(zip(spec.names(), design_columns(spec)))
    dense = np.array([spec.row({"f": r[0], "g": r[1], "x": r[2]}) for r in rows])
    assert matrix(gram(df, cols), spec.names()) == pytest.approx(dense.T @ dense)
    wide = {**cols, "y": F.col("y")}
    assert matrix(gram(df, wide), [*spec.names(), "y"])[-1, -1] == pytest.approx(sum(r[3] ** 2 for r in rows))
    small = ModelSpec([("f",), ("x",)], {"f": ["a", "b"]})
    fit = fit_gaussian(df, small, "y")
    x = np.array([small.row({"f": r[0], "x": r[2]}) for r in rows])
    beta, *_ = np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)
    assert fit.beta == pytest.approx(beta)
    assert fit_gaussian(df, small, "y", "f").variance["b"] > 2 * fit_gaussian(df, small, "y", "f").variance["a"]


def test_contrast_wald_and_ratio(spark):
    coef = literal_frame(spark, [("m", "p:intercept", "intercept", "p", 1.0, math.inf), ("m", "q:intercept", "intercept", "q", 3.0, math.inf)],
                         "model string, term string, part string, g string, estimate double, df double")
    v = np.array([[0.5, 0.1], [0.1, 0.4]])
    names = ["p:intercept", "q:intercept"]
    vcov = literal_frame(spark, [("m", a, b, float(v[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "model string, term_i string, term_j string, value double")
    out = C.contrast(coef, vcov, C.cell_weights(coef, "intercept", [], {"g": ("p", "q")}), []).first()
    assert (out["estimate"], out["se"]) == pytest.approx((2.0, math.sqrt(0.7)))
    assert out["p_value"] == pytest.approx(math.erfc(2 / math.sqrt(0.7) / math.sqrt(2)))
    w = C.wald(coef, vcov, C.term_tests(spark, {"g": ["p", "q"]})).first()
    assert (w["test"], w["df"], w["chisq"]) == ("g", 1, pytest.approx(4 / 0.7))
    assert w["p_value"] == pytest.approx(out["p_value"])


def test_holm_is_monotone_and_not_below_raw(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.5]
    got = {r["i"]: r["p_adjusted"] for r in C.holm(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    order = np.argsort(p, kind="stable")
    want, top = {}, 0.0
    for place, i in enumerate(order):
        top = max(top, (len(p) - place) * p[i])
        want[int(i)] = min(1.0, top)
    assert got == pytest.approx(want)


def test_durbin_watson_does_not_depend_on_stretches(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=50)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(e)], "s string, t int, e double")
    want = (np.diff(e) ** 2).sum() / ((e - e.mean()) ** 2).sum()
    for width in (3.0, 1000.0):
        assert D.durbin_watson(df, ["s"], "t", "e", width).first()["dw"] == pytest.approx(want)


def test_residuals_are_uniform_and_reproducible(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(simulated("nb2", n=800))], "i int, cell string, x double, y int")
    fit = glm.fit_cells(df, ["cell"], "y", "x", "nb2")
    once = D.pit_residuals(glm.fitted_rows(df.repartition(5), fit, x="x"), "nb2", ["i"], "y")
    again = D.pit_residuals(glm.fitted_rows(df.coalesce(1), fit, x="x"), "nb2", ["i"], "y")
    joined = join_on(once.select("i", "u"), again.select("i", F.col("u").alias("v")), ["i"])
    assert joined.where("abs(u - v) > 1e-12").count() == 0
    assert D.ks_uniform(once).first()["p_value"] > 0.01
    assert D.outlier_test(once).first()["p_value"] > 0.001


def test_marginal_residuals_of_mixed_data_are_uniform(spark):
    """Over the effect's distribution residuals are uniform; at the mean effect alone they are not."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(3000):
        mu = math.exp(1.0 + rng.normal() * 0.9)
        rows.append((i, "one" if i % 2 else "two", 0 if rng.random() < 0.2 else int(rng.poisson(rng.gamma(2.0, mu / 2.0)))))
    df = spark.createDataFrame(rows, "i int, g string, y int").withColumns({"mu": F.lit(math.exp(1.0)), "phi": F.lit(2.0), "zi": F.lit(0.2), "s": F.lit(0.9)})
    fair = D.pit_residuals(df, "nb2", ["i"], "y", sigma="s")
    assert all(r["p_value"] > 0.01 for r in D.ks_uniform(fair, by=["g"]).collect())
    assert D.ks_uniform(D.pit_residuals(df, "nb2", ["i"], "y")).first()["p_value"] < 0.001
    both = {r["g"]: r for r in D.pearson_dispersion(df, "nb2", "y", 1, ["g"], "s").collect()}
    assert both["one"]["df"] == 1499 and all(0.6 < r["dispersion"] < 1.6 for r in both.values())
    assert all(r["p_value"] > 0.001 for r in D.zero_test(df, "nb2", "y", ["g"], "s").collect())
    assert {r["g"] for r in D.outlier_test(fair, by=["g"]).collect()} == {"one", "two"}
    mean, variance = D.marginal_moments("nb2", F.col("zi"), F.col("mu"), F.col("phi"), F.col("s"))
    m, v = df.limit(1).select(mean, variance).first()
    lift = math.exp(0.9**2 / 2)
    square = math.exp(1.0) * lift + 1.5 * math.exp(2.0) * math.exp(2 * 0.9**2)
    assert m == pytest.approx(0.8 * math.exp(1.0) * lift, rel=1e-6) and v == pytest.approx(0.8 * square - m * m, rel=1e-4)


def test_residual_steps_are_computed_once_per_line_and_count(spark, monkeypatch):
    """One Python function gives a row's steps over all nodes, and evaluates each distinct line and count once per task."""
    rows = [(i, [0, 1, 2, 5, 40, None][i % 6], [0.5, 3.0, None][i % 3], [0.7, 2.0][i % 2], None if i == 3 else 0.8) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, y int, mu double, phi double, s double").withColumn("zi", F.lit(0.1))
    for family in ("poisson", "nb1", "nb2"):
        out = D.pit_residuals(df, family, ["i"], "y", sigma="s")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(set(re.findall(r"pythonUDF\d+", plan))) == 1
        cdf = lambda c, m: special.poisson_cdf(c, m) if family == "poisson" else special.negative_binomial_cdf(c, m, "phi" if family == "nb2" else m / F.col("phi"))
        at = lambda c: 0.1 + 0.9 * D.over_effects(lambda m: cdf(c, m), F.col("mu"), F.col("s"))
        low = F.when(F.col("y") <= 0, 0.0).otherwise(at(F.col("y") - 1))
        draw = F.shiftrightunsigned(F.xxhash64("i", F.lit(D.SEED)), 11) / F.lit(float(2**53))
        want = {r["i"]: r["w"] for r in df.select("i", (low + draw * (F.when(F.col("y") >= 0, at(F.col("y"))) - low)).alias("w")).collect()}
        got = {r["i"]: r["u"] for r in out.select("i", "u").collect()}
        assert {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
        assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items() if v is not None)
    seen = []
    true = special._count_cdf
    monkeypatch.setattr(special, "_count_cdf", lambda family, y, mu, phi: seen.append(len(y)) or true(family, y, mu, phi))
    batch = [pd.Series(v, dtype=float) for v in (list(range(20)) * 50, [2.0] * 1000, [1.5] * 1000, [0.0] * 1000)]
    first, second = special._count_steps("nb2", [(0.0, 1.0)]).func(iter([batch, batch]))
    assert sum(seen) == 21 and first.equals(second) and first["below"][1] == first["upto"][0]
    monkeypatch.setattr(special, "KNOWN_STEPS", 5)  # forgotten values are computed again
    assert all(first.equals(again) for again in special._count_steps("nb2", [(0.0, 1.0)]).func(iter([batch, batch])))


def test_implicit_zeros_fit_like_filled_ones(spark):
    rng = np.random.default_rng(13)
    surveys = [(f"s{k}", "ab"[k % 2], float(k % 7)) for k in range(80)] + [("s99", "c", 1.0)]
    filled = [(i, t, x, sp, int(rng.poisson(0.7 if sp == "p" else 0.2))) for i, t, x in surveys for sp in ("p", "q")]
    filled = [(i, t, x, sp, 0 if t == "c" else y) for i, t, x, sp, y in filled]
    frame = spark.createDataFrame(surveys, "survey string, type string, x double")
    seen = spark.createDataFrame([r for r in filled if r[4] > 0 or r[3] == "q"], "survey string, type string, x double, sp string, y int")
    rows = sparse.weighted_counts(seen, frame, ["type"], ["sp"], "y", "x")
    assert rows.agg(F.sum("n")).first()[0] == 160
    key = lambda df: sorted((r["type"], r["sp"], round(r["a"], 8), round(r["b"], 8), round(r["phi"], 6)) for r in df.coef.collect())
    full = spark.createDataFrame([r for r in filled if r[1] != "c"], "survey string, type string, x double, sp string, y int")
    assert key(glm.fit_cells(rows, ["type", "sp"], "y", "x", "nb2", weight="n")) == key(glm.fit_cells(full, ["type", "sp"], "y", "x", "nb2"))
    listed = sparse.weighted_counts(seen, frame, ["type"], ["sp"], "y", "x", categories=spark.createDataFrame([("p",), ("q",), ("r",)], "sp string"))
    assert listed.agg(F.sum("n")).first()[0] == 81 * 3 and listed.where("y > 0").count() == rows.where("y > 0").count()
    checks = sparse.weighted_checks(rows.withColumns({"mu": F.lit(0.5), "phi": F.lit(1.0)}), "poisson", ["sp"], 2)
    want = {sp: sum((r[4] - 0.5) ** 2 / 0.5 for r in filled if r[3] == sp and r[1] != "c") for sp in ("p", "q")}
    assert {r["sp"]: r["chisq"] for r in checks.collect()} == pytest.approx(want)
    assert sparse.weighted_counts(seen.limit(0), frame, ["type"], ["sp"], "y", "x").count() == 0


def test_health_table_of_mixed_fits(spark):
    rows = [("one", *r, i) for i, r in enumerate(_clustered(7, 60, zero=0.0))] + [("two", *r, i) for i, r in enumerate(_clustered(8, 60, zero=0.0, phi=20.0))]
    df = spark.createDataFrame(rows, "sp string, k string, g string, t double, y int, i int")
    fit = mixed.fit_mixed(df, ["sp", "g"], "y", "k", None, "nb2", model_by=["sp"])
    table = {r["model"]: r for r in D.health_table(df, fit, ["sp", "i"], "y").collect()}
    assert set(table) == {"one", "two"}
    one, two = table["one"], table["two"]
    assert 0.3 < one["cluster_sd"] < 1.0 and one["n_par"] == 4 and not one["at_boundary"]
    # The likelihood of the second sample falls in sigma from zero on (profiled over a grid): a boundary fit.
    assert two["at_boundary"] and two["cluster_sd"] == pytest.approx(mixed.SIGMA_FLOOR) and two["n_par"] == 3
    for r in table.values():
        assert r["converged"] and r["positive_definite"]
        assert all(0.001 < r[p] <= 1 for p in ("uniformity_p", "dispersion_p", "zero_p", "outlier_p"))


def test_reference_grid_means(spark):
    spec = ModelSpec([("f",), ("x",), ("g",), ("f", "x"), ("f", "g")], {"f": ["a", "b"], "g": ["u", "v", "w"]})
    at = spark.createDataFrame([("s", -1.0), ("e", 2.0)], "label string, x double")
    grid = reference_grid(at, spec, {"g": ["u", "v"]})
    assert grid.count() == 2 * 2 * 2
    got = {(r["label"], r["f"], r["term"]): r["weight"] for r in mean_weights(grid, spec, ["label", "f"]).collect()}
    for label, x in (("s", -1.0), ("e", 2.0)):
        for f in "ab":
            want = np.mean([spec.row({"f": f, "g": g, "x": x}) for g in "uv"], axis=0)
            assert [got.get((label, f, n), 0.0) for n in spec.names()] == pytest.approx(list(want))
    apart = {(r["label"], r["term"]): r["weight"] for r in mean_weights(grid, spec, ["label"], {"f": ("a", "b")}).collect()}
    twice = {r["term"]: r["weight"] for r in mean_weights(grid.where("label = 's'"), spec, [], {"f": ("a", "b"), "g": ("u", "v")}).collect()}
    mean = lambda f, x, gs: np.mean([spec.row({"f": f, "g": g, "x": x}) for g in gs], axis=0)
    assert [apart.get(("e", n), 0.0) for n in spec.names()] == pytest.approx(list(mean("b", 2.0, "uv") - mean("a", 2.0, "uv")))
    want = mean("b", -1.0, "v") - mean("a", -1.0, "v") - mean("b", -1.0, "u") + mean("a", -1.0, "u")
    assert [twice.get(n, 0.0) for n in spec.names()] == pytest.approx(list(want))


# --- special functions ---------------------------------------------------------------------


def test_special_functions(spark):
    rows = spark.createDataFrame([(0.3,), (2.5,), (40.0,), (5e6,)], "x double")
    for r in rows.select("x", special.lgamma("x").alias("g"), special.digamma("x").alias("d"), special.trigamma("x").alias("t")).collect():
        h = 1e-3 * r["x"]
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-9, abs=1e-9)
        assert r["d"] == pytest.approx((math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h), rel=1e-4)
    row = spark.range(1).select(
        special.chi2_upper_tail(F.lit(3.841458821), F.lit(1)).alias("c"), special.f_upper_tail(F.lit(4.0), F.lit(2), F.lit(10)).alias("f"),
        special.t_two_sided(F.lit(2.228138852), F.lit(10)).alias("t"), special.poisson_cdf(F.lit(3), F.lit(2.0)).alias("p"),
        special.negative_binomial_cdf(F.lit(1), F.lit(2.0), F.lit(3.0)).alias("n"), special.binomial_cdf(F.lit(2), F.lit(5), F.lit(0.3)).alias("b"),
        special.f_upper_tail(F.lit(None).cast("double"), F.lit(2), F.lit(10)).alias("z"),
    ).first()
    assert row["c"] == pytest.approx(0.05, abs=1e-8) and row["t"] == pytest.approx(0.05, abs=1e-8)
    assert row["f"] == pytest.approx((1 + 2 * 4 / 10) ** -5)
    assert row["p"] == pytest.approx(math.exp(-2) * (1 + 2 + 2 + 8 / 6))
    assert row["n"] == pytest.approx(0.6**3 * (1 + 3 * 0.4))
    assert row["b"] == pytest.approx(sum(math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(3)))
    assert row["z"] is None


def test_contrast_with_an_all_zero_cell_or_an_absent_side_is_null(spark):
    rows = [(p, t, g, y) for p in ("p0", "p1", "p2") for t in ("Natural", "Artificial") for g in ("a", "b") for y in (1, 2, 4)]
    rows = [(p, t, g, 0 if (p, t, g) == ("p0", "Artificial", "a") else y) for p, t, g, y in rows if (p, t) != ("p1", "Artificial")]
    rows = [r for r in rows if r[:3] != ("p2", "Natural", "b")]
    fit = glm.closed_form(spark.createDataFrame(rows, "pair string, type string, guild string, y int"), ["pair", "type", "guild"], "y")
    coef, vcov = glm.coefficients(fit), glm.covariance(fit)
    step = {"type": ("Natural", "Artificial")}
    found = {r["pair"]: r for r in C.contrast(coef, vcov, C.cell_weights(coef, "intercept", ["pair"], step), ["pair"]).collect()}
    for pair in ("p0", "p1", "p2"):  # an all-zero cell, an absent side, an absent cell
        assert all(found[pair][c] is None for c in ("estimate", "se", "lower", "upper", "p_value"))
    means = {(r["pair"], r["type"]): r for r in C.contrast(coef, vcov, C.cell_weights(coef, "intercept", ["pair", "type"]), ["pair", "type"]).collect()}
    assert means["p0", "Artificial"]["estimate"] is None and means["p2", "Natural"]["estimate"] is None
    assert means["p0", "Natural"]["estimate"] == pytest.approx(math.log(7 / 3))


def test_t_interval_at_few_degrees_of_freedom(spark):
    got = [r[0] for r in spark.createDataFrame([(1.0,), (2.0,), (5.0,), (30.0,), (math.inf,)], "df double").select(special.t_975("df")).collect()]
    assert got == pytest.approx([12.7062047, 4.3026527, 2.5705818, 2.0422725, 1.9599640], rel=1e-6)


def test_durbin_watson_of_tied_times_has_one_answer(spark):
    rows = [("s", 1, 2.0), ("s", 1, -1.0), ("s", 2, 0.5), ("s", 2, 1.5), ("s", 3, -2.0), ("s", 3, -1.0), ("s", 4, 1.0)]
    answers = {
        round(D.durbin_watson(spark.createDataFrame(order, "s string, t int, e double"), ["s"], "t", "e").first()["dw"], 9)
        for order in (rows, rows[::-1], rows[1:] + rows[:1])
    }
    assert len(answers) == 1


def test_aliased_terms_are_null(spark):
    rows = [("a", "u", 1.0), ("a", "u", 2.0), ("b", "v", 3.0), ("b", "v", 5.0)]
    spec = ModelSpec([("f",), ("g",)], {"f": ["a", "b"], "g": ["u", "v"]})
    fit = fit_gaussian(spark.createDataFrame(rows, "f string, g string, y double"), spec, "y")
    got = {r["term"]: r["estimate"] for r in fit.coefficients(spark).collect()}
    assert len(fit.stats["aliased"]) == 2 and [v for v in got.values() if v is not None] == pytest.approx([1.5])


def test_gaussian_residuals_and_dispersion_p(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 4.0), (3.0, 1.0, 4.0)], "y double, mu double, phi double")
    got = sorted(r["u"] for r in D.pit_residuals(rows, "gaussian", ["y"], "y").collect())
    assert got == pytest.approx([0.3085375387, 0.8413447461])
    counts = spark.createDataFrame([(1, 1.0, 1.0), (4, 2.0, 1.0), (0, 1.0, 1.0)], "y int, mu double, phi double")
    out = D.pearson_dispersion(counts, "poisson", "y", 1).first()
    assert out["chisq"] == pytest.approx(3.0) and out["p_value"] == pytest.approx(math.exp(-1.5))


@pytest.mark.parametrize("family", ["poisson", "nb1", "nb2"])
def test_node_terms_equal_the_column_expressions(spark, family):
    from surveyframe.models import families, nodes

    rows = [(float(y), phi, eta) for y in (0, 1, 7, 400) for phi in (1e-3, 0.4, 2.0, 5e3) for eta in (-6.0, 0.0, 1.5, 6.0)]
    df = families.with_derivatives(spark.createDataFrame(rows, "y double, phi double, eta double"), family)
    df = df.withColumn("ll", families.loglik(family, F.col("y"), F.col("mu"), F.col("phi")))
    y, phi, eta = np.array([[r[k] for k in ("y", "phi", "eta")] for r in df.collect()]).T
    got = nodes.count_terms(family, y, phi, eta[:, None])
    names = ["ll", "d1", "w"] if family == "nb2" else ["ll", "d1", "w", "obs"]
    for name in names + (["up"] if family != "poisson" else []):
        want = [r[name] for r in df.collect()]
        assert got[name][:, 0] == pytest.approx(want, rel=1e-6, abs=1e-6 * max(1.0, np.abs(want).max()) if name == "up" else 1e-7), name


def test_mixed_rounds_write_no_row_per_node_and_wide_clusters_agree(spark, monkeypatch):
    """Rounds keep a row per distinct cluster; clusters over the list limit go another way to the same fit."""
    rows = _clustered(4, 40) + [(f"t{k}", g, 0.5, 3) for k in range(30) for g in ("x", "y")]
    df = spark.createDataFrame(rows + [(None, "x", 0.1 * k, k) for k in range(6)], "k string, g string, t double, y int")
    plans, kept, real = [], [], mixed.stored

    def spied(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        out = real(frame)
        if "curve" in out.columns and "i" in out.columns:
            kept.append(out.where("i is null").count())
        return out

    monkeypatch.setattr(mixed, "stored", spied)
    fit = mixed.fit_mixed(df, ["g"], "y", "k", "t", "nb2", zi_by=["g"])
    assert not any("posexplode" in p for p in plans) and set(kept) == {42}
    assert fit.stats["n_clusters"] == 71 and fit.clusters.count() == 71
    monkeypatch.setattr(mixed, "LIST_ROWS", 2)
    other = mixed.fit_mixed(df, ["g"], "y", "k", "t", "nb2", zi_by=["g"])
    assert any("posexplode" in p for p in plans)
    assert other.stats["loglik"] == pytest.approx(fit.stats["loglik"], rel=1e-9) and other.stats["n_clusters"] == 71
    row = lambda f: [tuple(r) for r in f.coef.orderBy("g").select("a", "b", "phi", "zi", "v00", "v11").collect()]
    assert row(other) == [pytest.approx(r, rel=1e-6) for r in row(fit)]
    effects = lambda f: {r["cluster"]: (r["m"], r["s"]) for r in f.clusters.collect()}
    assert effects(other)[None] == pytest.approx(effects(fit)[None], rel=1e-5)


def test_crossed_wide_clusters_agree_and_rounds_read_lists(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"c{c}", f"s{k}", g, int(rng.poisson(3))) for c in range(20) for k in range(3) for g in ("j", "a")] + [("c0", "s0", "j", 40 + k) for k in range(5)]
    df = spark.createDataFrame(rows, "k string, sp string, g string, y int")
    plans, real = [], mixed.stored

    def spied(frame):
        if "step" in frame.columns and "effect" in frame.columns:
            plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return real(frame)

    monkeypatch.setattr(mixed, "stored", spied)
    fit = mixed.fit_crossed(df, ["g"], "y", "k", "sp", "nb2")
    assert plans and not any("Aggregate" in p or "Join" in p for p in plans)
    monkeypatch.setattr(mixed, "LIST_ROWS", 6)
    other = mixed.fit_crossed(df, ["g"], "y", "k", "sp", "nb2")
    assert any("Aggregate" in p for p in plans)
    assert other.stats["loglik"] == pytest.approx(fit.stats["loglik"], rel=1e-8)
    effects = lambda f: [r["m"] for r in f.clusters.orderBy("cluster").collect()]
    assert effects(other) == pytest.approx(effects(fit), abs=1e-5) and len(effects(fit)) == 20
