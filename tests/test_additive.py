"""Additive models from grouped sums against fits in one piece."""

import math

import numpy as np
import pytest

from chainframe.operators import additive, trends

LINE = ("gaussian", "identity")
CELLS = "var string, lineage string, t double, y double, w double"


def drawn(distribution: str, seed: int, n: int = 160):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.random(n)) * 5
    mean = np.exp(0.6 + 0.7 * np.sin(t))
    y = {
        "gaussian": lambda: mean + rng.normal(0, 0.3, n),
        "poisson": lambda: rng.poisson(mean).astype(float),
        "gamma": lambda: rng.gamma(3, mean / 3),
        "inv_gauss": lambda: rng.wald(mean, 4 * mean),
        "binomial": lambda: (rng.random(n) < 1 / (1 + np.exp(-2 * np.sin(t)))).astype(float),
        "negative_binomial": lambda: rng.negative_binomial(2, 2 / (2 + 4 * mean)).astype(float),
    }[distribution]()
    return t, y, 0.2 + rng.random(n)


def table(spark, parts: dict):
    return spark.createDataFrame([(v, "p", float(a), float(b), float(c)) for v, (t, y, w) in parts.items() for a, b, c in zip(t, y, w)], CELLS)


@pytest.mark.parametrize("distribution,link", [("gaussian", "identity"), ("poisson", "log"), ("gamma", "log"), ("binomial", "logit")])
def test_equals_the_fit_in_one_piece(spark, distribution, link):
    parts = {f"g{k}": drawn(distribution, k) for k in range(2)}
    models = additive.fit(table(spark, parts), distribution, link, penalty=[0.3, 30.0])
    chosen = {r["var"]: r["penalty"] for r in models.collect()}
    found = additive.predict(models, link, 15, 0.9).toPandas()
    for name, (t, y, w) in parts.items():
        grid = np.linspace(t.min(), t.max(), 15)
        assert chosen[name] == trends.best_penalty(t, y, w, [0.3, 30.0], distribution=distribution, link=link)
        expected = trends.fit_spline(t, y, w, grid, distribution=distribution, link=link, penalty=chosen[name], level=0.9)
        own = found[found["var"] == name].sort_values("t")
        assert np.allclose(own[["t", "y", "low", "high"]].to_numpy(), np.stack([grid, *expected], 1), atol=1e-6)


def test_expectiles(spark):
    t, y, w = drawn("gaussian", 5)
    found = additive.predict(additive.fit(table(spark, {"g": (t, y, w)}), "gaussian", "identity", expectile=0.9), "identity", 12).toPandas().sort_values("t")
    grid = np.linspace(t.min(), t.max(), 12)
    assert np.allclose(found["y"], trends.fit_spline(t, y, w, grid, expectile=0.9)[0], atol=1e-6)


def likelihood(t, y, w, o, theta, penalty=0.6):
    """(penalized log likelihood, coefficients) of a negative binomial of that size parameter, by Newton steps in one piece."""
    b = trends.basis(t, np.linspace(t.min(), t.max(), 6))
    ridge = penalty * np.diff(np.eye(8), 2, axis=0).T @ np.diff(np.eye(8), 2, axis=0) + 1e-8 * np.eye(8)
    eta = np.log(np.maximum(y, 1e-3))
    for _ in range(60):
        mean = np.exp(eta)
        k = w * mean / (1 + mean / theta)
        beta = np.linalg.solve(b.T @ (k[:, None] * b) + ridge, b.T @ (k * (eta - o + (y - mean) / mean)))
        eta = b @ beta + o
    mean = np.exp(eta)
    terms = [math.lgamma(v + theta) - math.lgamma(theta) - math.lgamma(v + 1) for v in y]
    return (w * (terms + theta * np.log(theta / (theta + mean)) + y * np.log(mean / (theta + mean)))).sum() - beta @ ridge @ beta / 2, beta


def test_negative_binomial_with_offsets(spark):
    t, y, w = drawn("negative_binomial", 3)
    o = np.random.default_rng(4).normal(0, 0.3, len(t))
    rows = [("g", "p", *map(float, r)) for r in zip(t, y, w, o)]
    found = additive.fit(spark.createDataFrame(rows, CELLS + ", offset double"), "negative_binomial").first()
    low, high = -3.0, 6.0  # the size parameter of greatest profile likelihood by golden section
    for _ in range(60):
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if likelihood(t, y, w, o, math.exp(a))[0] > likelihood(t, y, w, o, math.exp(b))[0] else (a, high)
    assert found["error"] is None
    assert math.log(found["theta"]) == pytest.approx((low + high) / 2, abs=1e-4)
    assert np.allclose(found["beta"], likelihood(t, y, w, o, found["theta"])[1], atol=1e-5)


def test_counts_without_more_spread_become_poisson(spark):
    t, _, w = drawn("poisson", 1)
    y = np.round(np.exp(0.6 + 0.7 * np.sin(t)))  # less spread than a Poisson
    models = additive.fit(table(spark, {"g": (t, y, w)}), "negative_binomial")
    expected = trends.fit_spline(t, y, w, np.linspace(t.min(), t.max(), 9), distribution="poisson", link="log")[0]
    assert models.first()["theta"] > 1e5 and np.allclose(additive.predict(models, n_points=9).toPandas().sort_values("t")["y"], expected, atol=1e-3)


def test_natural_ends_are_straight(spark):
    t, y, w = drawn("gaussian", 2)
    models = additive.fit(table(spark, {"g": (t, y, w)}), "gaussian", "identity", natural=True, penalty=0.01)
    beta = np.array(models.first()["beta"])
    bends = np.diff(beta, 2)
    assert abs(bends[0]) < 1e-9 and abs(bends[-1]) < 1e-9 and np.abs(bends).max() > 0.1
    b = trends.basis(t, np.linspace(t.min(), t.max(), 6))
    straight = additive.fit(table(spark, {"g": (t, 2 * t + 1, w)}), "gaussian", "identity", natural=True, penalty=1e6).first()["beta"]
    assert np.allclose(b @ np.array(straight), 2 * t + 1, atol=1e-5)


def test_awkward_tables(spark):
    t, y, w = drawn("gamma", 7, 40)
    rows = [("g", "p", float(a), float(b), float(c)) for a, b, c in zip(t, y, w)]
    odd = [("h", "p", 1.0, 2.0, 1.0), ("h", "p", 1.0, 3.0, 1.0), ("g", "p", None, 1.0, 1.0), ("g", "p", 1.0, None, 1.0), ("g", "p", 1.0, float("nan"), 1.0), (None, "p", 1.0, 1.0, 1.0)]
    clean, mixed = additive.fit(spark.createDataFrame(rows, CELLS), *LINE), additive.fit(spark.createDataFrame(rows + odd, CELLS).selectExpr("*", "1 AS beta", "2 AS low", "3 AS s"), *LINE)
    got = {r["var"]: r for r in mixed.collect()}
    assert set(got) == {"g", "h"} and got["h"]["error"] == "ValueError: one time only" and got["h"]["beta"] is None
    assert np.allclose(got["g"]["beta"], clean.first()["beta"], atol=1e-8)
    doubled = additive.fit(spark.createDataFrame(rows + rows, CELLS), *LINE, penalty=1.2).first()
    assert np.allclose(doubled["beta"], clean.first()["beta"], atol=1e-6)  # repeated rows count twice
    assert additive.fit(spark.createDataFrame([], CELLS)).collect() == []
    assert sorted((r["var"], r["error"] is None) for r in additive.predict(mixed, n_points=2).collect()) == [("g", True), ("g", True), ("h", False)]
    late = additive.fit(spark.createDataFrame(rows, CELLS), max_steps=2).first()
    assert late["beta"] is None and "not settled" in late["error"]


def test_salted_keys_give_the_same(spark, monkeypatch):
    cells = table(spark, {"g": drawn("gamma", 1, 60), "h": drawn("gamma", 2, 60)})
    plain = sorted(additive.fit(cells, *LINE).select("var", "beta").collect())
    monkeypatch.setattr(additive, "BROADCAST_GROUPS", 1)
    salted = sorted(additive.fit(cells, *LINE).select("var", "beta").collect())
    assert np.allclose([r["beta"] for r in plain], [r["beta"] for r in salted], atol=1e-8)


def test_predictions_at_rows_and_new_weights(spark):
    t, y, w = drawn("gaussian", 9)
    y = y.copy()
    y[40] += 50
    cells = table(spark, {"g": (t, y, w)})
    models = additive.fit(cells, "gaussian", "identity")
    found = additive.predict_at(models, cells, "identity").toPandas().sort_values("t")
    assert np.allclose(found["fitted"], trends.fit_spline(t, y, w, t)[0], atol=1e-6)
    beyond = spark.createDataFrame([("g", "p", -9.0), ("g", "p", float(t.min())), ("x", "p", 1.0), ("g", "p", None)], "var string, lineage string, t double")
    fitted = {(r["var"], r["t"]): r["fitted"] for r in additive.predict_at(models, beyond, "identity").collect()}
    assert fitted["g", -9.0] == pytest.approx(fitted["g", float(t.min())]) and fitted["x", 1.0] is None and fitted["g", None] is None
    weighed = additive.residual_weights(models, cells, "identity").toPandas().sort_values("t")
    assert weighed["w"].iloc[40] == 0 and (weighed["w"].drop(weighed.index[40]) > 0).mean() > 0.9
    again = additive.predict_at(additive.fit(additive.residual_weights(models, cells, "identity"), "gaussian", "identity"), cells, "identity").toPandas().sort_values("t")
    assert np.abs(again["fitted"].to_numpy() - np.exp(0.6 + 0.7 * np.sin(t))).max() < 0.5
