"""Chains that mix slowly or leave rarely: results must not depend on the method, on the order of rows or on the number of states."""

import numpy as np
import pytest

from chainframe.linalg.dense import blocks, gth, sorted_schur, stationary_from_uniform
from chainframe.linalg.krylov import gmres
from chainframe.operators import chains
from chainframe.sources.store import from_entries
from tests.test_operators import CHAIN, LEAKING, dense

RARE = 1e-6


def entries(t):
    return [(int(i), int(j), float(t[i, j])) for i, j in zip(*np.nonzero(t))]


def ring(n, seed):
    rng = np.random.default_rng(seed)
    t = np.zeros((n, n))
    for i in range(n):
        t[i, (i + 1) % n], t[i, (i - 1) % n] = rng.random(2) + 0.01
    return t / t.sum(1, keepdims=True)


def by_trees(t):
    """The stationary distribution from a linear system in 40 digits."""
    from fractions import Fraction

    n = len(t)
    a = [[Fraction(t[j, i]) - (i == j) * sum(Fraction(x) for x in t[i]) for j in range(n)] for i in range(n)]
    a[-1] = [Fraction(1)] * n
    b = [Fraction(0)] * (n - 1) + [Fraction(1)]
    for k in range(n):
        p = next(r for r in range(k, n) if a[r][k])
        a[k], a[p], b[k], b[p] = a[p], a[k], b[p], b[k]
        for r in range(k + 1, n):
            f = a[r][k] / a[k][k]
            if f:
                a[r] = [x - f * y for x, y in zip(a[r], a[k])]
                b[r] -= f * b[k]
    x = [Fraction(0)] * n
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - sum(a[k][j] * x[j] for j in range(k + 1, n))) / a[k][k]
    return np.array([float(y) for y in x])


def test_stationary_distribution_in_any_order_of_rows(spark):
    t = dense(CHAIN)
    want = by_trees(t)
    for seed in range(20):
        turn = np.random.default_rng(seed).permutation(12)
        p = np.empty(12)
        p[turn] = stationary_from_uniform(t[np.ix_(turn, turn)])
        assert abs(p - want).max() < 1e-12 and abs(p.sum() - 1) < 1e-14
    for seed in range(3):
        rows = [entries(t)[k] for k in np.random.default_rng(seed).permutation(len(entries(t)))]
        found = {r["i"]: r["p"] for r in chains.stationary(from_entries(spark, rows)).collect()}
        assert [found[k] for k in range(12)] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("method", ["direct", "krylov"])
def test_stationary_distribution_of_rings_and_nearly_closed_blocks(spark, method):
    slow = np.zeros((8, 8))
    slow[:4, :4], slow[4:, 4:] = ring(4, 1), ring(4, 2)
    slow[0] *= 1 - 1e-9
    slow[0, 5] = 1e-9
    slow[6] *= 1 - 3e-9
    slow[6, 2] = 3e-9
    for t in (ring(60, 0), ring(61, 3), slow) if method == "direct" else (ring(16, 0), slow):
        found = {r["i"]: r["p"] for r in chains.stationary(from_entries(spark, entries(t)), tol=1e-11, method=method).collect()}
        p = np.array([found[k] for k in range(len(t))])
        assert abs(p.sum() - 1) < 1e-12 and abs(p @ t - p).sum() < 1e-11
        assert p == pytest.approx(gth(t), rel=1e-5)


@pytest.mark.parametrize("method", ["direct", "krylov"])
def test_several_closed_classes_share_by_the_chance_to_end_there(spark, method):
    t = np.zeros((7, 7))
    t[0, 0] = 1
    t[1, 2] = t[2, 1] = 1
    t[3, 0], t[3, 4] = 0.25, 0.75
    t[4, 3], t[4, 2] = 0.5, 0.5
    t[5, 4] = t[6, 5] = 1
    p = {r["i"]: r["p"] for r in chains.stationary(from_entries(spark, entries(t)), method=method).collect()}
    end = np.linalg.solve(np.eye(4) - t[3:, 3:], t[3:, 0])
    assert p == pytest.approx({0: (1 + end.sum()) / 7, 1: (6 - end.sum()) / 14, 2: (6 - end.sum()) / 14, 3: 0, 4: 0, 5: 0, 6: 0}, abs=1e-9)


@pytest.mark.parametrize("method", ["auto", "direct", "krylov"])
def test_states_that_leave_rarely_have_their_true_fates(spark, method):
    rows = [(0, 0, 1 - RARE), (0, 10, 0.3 * RARE), (0, 11, 0.7 * RARE), (1, 0, 0.5), (1, 2, 0.5), (2, 1, 0.9), (2, 11, 0.1), (3, 4, 1.0), (4, 3, 1 - RARE), (4, 10, RARE)]
    ends = spark.createDataFrame([(10, "a"), (11, "b")], "obs long, state string")
    edges = from_entries(spark, rows)
    found = {r["i"]: (r["a"], r["b"]) for r in chains.fate_probabilities(edges, ends, ["a", "b"], method=method).collect()}
    one = (0.3, 0.7)
    two = ((0.5 * 0.3 + 0.5 * 0) / (1 - 0.45), 1 - 0.15 / 0.55)
    assert found[0] == pytest.approx(one, abs=1e-6) and found[1] == pytest.approx((two[0], 1 - two[0]), abs=1e-6)
    assert found[3] == pytest.approx((1, 0), abs=1e-6) and found[4] == pytest.approx((1, 0), abs=1e-6)
    times = {r["i"]: (r["mean"], r["var"]) for r in chains.absorption_times(edges, ends, method=method).collect()}
    assert times[0] == pytest.approx((1 / RARE, (1 - RARE) / RARE**2), rel=1e-6)
    assert times[4] == pytest.approx((2 / RARE - 1, 4 * (1 - RARE) / RARE**2), rel=1e-6) and all(v >= 0 for _, v in times.values())
    given = {r["i"]: (r["mean"], r["var"]) for r in chains.conditional_absorption_times(edges, ends, "a", ["a", "b"], method=method).collect()}
    assert given[0] == pytest.approx((1 / RARE, (1 - RARE) / RARE**2), rel=1e-6) and given[11][0] == float("inf") and given[10] == (0, 0)


def test_repetition_that_would_end_too_early_raises(spark):
    q = from_entries(spark, [(0, 0, 1 - RARE)])
    b = spark.createDataFrame([(0, 0.3 * RARE)], "i long, x double")
    with pytest.raises(RuntimeError, match="no convergence"):
        chains.fixed_point(q, b, ["x"], max_steps=30)
    assert chains.fixed_point(q, b, ["x"], steps=1).first()["x"] == pytest.approx(0.3 * RARE * 2, rel=1e-5)


def test_gmres_equals_a_dense_solution(spark):
    rng = np.random.default_rng(2)
    t = rng.random((50, 50)) * (rng.random((50, 50)) < 0.2)
    t = 0.999 * t / np.maximum(t.sum(1, keepdims=True), 1e-9)
    b = rng.random((50, 3)) * [1, 1e-8, 0]
    table = spark.createDataFrame([(i, *map(float, b[i])) for i in range(50)], "i long, x double, `y 1` double, z double").withColumnRenamed("y 1", "y")
    found = sorted(map(tuple, gmres(from_entries(spark, entries(t)), table, ["x", "y", "z"], restart=12).collect()))
    assert np.allclose(np.array(found)[:, 1:] / [1, 1e-8, 1], np.linalg.solve(np.eye(50) - t, b) / [1, 1e-8, 1], rtol=1e-6, atol=1e-7)
    with pytest.raises(ValueError, match="never left"):
        gmres(from_entries(spark, [(0, 0, 1.0)]), table, ["x"])


@pytest.mark.parametrize("n, finish", [(10_000, 100_000), (30, 0)])
def test_a_long_path_and_a_chain_of_rings_have_their_classes(spark, n, finish):
    turn = np.random.default_rng(1).permutation(n).tolist()
    path = [(turn[k], turn[k + 1], 1.0) for k in range(n - 1)] + [(turn[-1], turn[-1], 1.0)]
    rings = [(n + 10 * a + k, n + 10 * a + (k + 1) % 10, 1.0) for a in range(3) for k in range(10)] + [(n + 10 * a, n + 10 * a + 10, 1.0) for a in range(2)]
    found = {r["node"]: (r["class"], r["recurrent"]) for r in chains.communicating_classes(spark.createDataFrame(path + rings, "i long, j long, w double"), 40, finish).collect()}
    assert found == {k: (k, k == turn[-1]) for k in range(n)} | {n + 10 * a + k: (n + 10 * a, a == 2) for a in range(3) for k in range(10)}


def test_schur_forms_are_sorted_and_split_no_pair():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 9, 24):
        for kind in range(4):
            a = rng.normal(size=(n, n)) if kind % 2 else rng.random((n, n))
            a = a + a.T if kind == 3 else a
            r, q = sorted_schur(a)
            assert np.allclose(q @ r @ q.T, a, atol=1e-11) and np.allclose(q.T @ q, np.eye(n), atol=1e-12) and not np.tril(r, -2).any()
            k, last = 0, np.inf
            for size in blocks(r):
                part = np.linalg.eigvals(r[k : k + size, k : k + size])
                assert size == 1 or abs(part.imag).min() > 0
                assert part.real.max() <= last + 1e-9
                k, last = k + size, part.real.max()
