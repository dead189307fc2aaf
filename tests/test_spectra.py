"""Leading spectra, Schur vectors and their residuals, on chains with conjugate pairs and repeated eigenvalues."""

import numpy as np
import pytest

from chainframe.linalg import arnoldi, packets
from chainframe.operators import macrostates, spectral
from chainframe.plans.queries import QUERIES
from chainframe.sources.store import from_entries
from tests.test_operators import CHAIN, dense


def table(spark, t):
    return from_entries(spark, [(int(i), int(j), float(t[i, j])) for i, j in zip(*np.nonzero(t))])


def rotating(groups=6, size=10, seed=4):
    """A chain that goes round groups of states, with noise: its second and third eigenvalues are a conjugate pair."""
    rng = np.random.default_rng(seed)
    n = groups * size
    t = 0.02 * rng.random((n, n))
    for a in range(groups):
        b = (a + 1) % groups
        t[a * size : (a + 1) * size, b * size : (b + 1) * size] += rng.random((size, size))
    return t / t.sum(1, keepdims=True)


def leading(t, k):
    values = np.linalg.eigvals(t)
    return values[np.lexsort((-values.imag, -values.real.round(9)))][:k]


def test_the_golden_chain_and_a_rotating_one(spark):
    for t, k in ((dense(CHAIN), 4), (rotating(), 3)):
        for left in (False, True):
            values, rows, residual = spectral.spectrum(table(spark, t), k, left)
            assert values == pytest.approx(leading(t, len(values)), abs=1e-8) and residual.max() < 1e-7
            got = {r["i"]: r for r in rows.collect()}
            for n, value in enumerate(values):
                v = np.array([complex(got[i][f"re{n}"], got[i][f"im{n}"]) for i in range(len(t))])
                a = t.T if left else t
                assert np.linalg.norm(a @ v - value * v) < 1e-7 and np.linalg.norm(v) == pytest.approx(1)
                top = v[np.argmax(abs(v).round(9))]
                assert abs(top.imag) < 1e-6 and top.real > 0


@pytest.mark.parametrize("dense", [1_000, 0])
def test_schur_vectors_span_an_invariant_subspace_and_split_no_pair(spark, dense, monkeypatch):
    monkeypatch.setattr(arnoldi, "DENSE", dense)
    t = rotating()
    basis, r, residual = arnoldi.invariant(table(spark, t), 2)
    assert r.shape == (3, 3) and r[2, 1] != 0 and abs(np.tril(r, -2)).max() == 0
    rows = {x["i"]: [x[f"x{k}"] for k in range(3)] for x in basis.collect()}
    x = np.array([rows[i] for i in range(len(t))])
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-9) and np.linalg.norm(t @ x - x @ r) < 1e-7 and residual < 1e-8
    if dense:
        chi, names, coarse = macrostates.macrostates(table(spark, t), 2)
        assert len(names) == 3 and np.allclose(coarse.sum(1), 1)


def test_a_repeated_eigenvalue_is_found_as_often_as_it_occurs(spark):
    rng = np.random.default_rng(3)
    t = np.zeros((64, 64))
    for a in range(4):  # four closed classes
        t[16 * a : 16 * a + 16, 16 * a : 16 * a + 16] = rng.random((16, 16))
    t /= t.sum(1, keepdims=True)
    values, _, residual = spectral.spectrum(table(spark, t), 4)
    assert values == pytest.approx(np.ones(4), abs=1e-8) and residual.max() < 1e-7


def test_wide_bases_make_no_wide_expressions(spark, monkeypatch):
    """What a step of the iteration writes: its plan had products of sums of all columns, and took Catalyst longer than the work."""
    rng = np.random.default_rng(6)
    t = rng.random((120, 120)) * (rng.random((120, 120)) < 0.2)
    t = (t + t.T + np.eye(120)) / (t + t.T + np.eye(120)).sum(1, keepdims=True)
    cut = arnoldi.cut

    def small(df):
        assert len(df._jdf.queryExecution().optimizedPlan().toJSON()) < 200_000
        return cut(df)

    monkeypatch.setattr(arnoldi, "DENSE", 50)
    monkeypatch.setattr(arnoldi, "cut", small)
    basis, r, gap = arnoldi.invariant(table(spark, t).coalesce(1), 2, 1e-2, columns=24)
    x = np.array([row[1:] for row in sorted(basis.collect())])
    assert np.allclose(x.T @ x, np.eye(2), atol=1e-9) and np.linalg.norm(t @ x - x @ r) < 2e-2


def small_packets(monkeypatch):
    monkeypatch.setattr(arnoldi, "DENSE", 50)
    for name, value in (("STATES", 24), ("LEAST", 4), ("PACKETS", 3), ("ENTRIES", 10)):
        monkeypatch.setattr(packets, name, value)


def test_a_product_of_packets_is_that_of_the_matrix(spark, monkeypatch):
    """Of several packets and rows of entries, ids that are no numbers, entries that occur twice, and states that none leads from or to."""
    small_packets(monkeypatch)
    rng = np.random.default_rng(8)
    t = rng.random((90, 90)) * (rng.random((90, 90)) < 0.1)
    t[:, 7] = rng.random(90)  # all lead to one
    t[3], t[:, 4] = 0, 0
    entries = [(f"s{i}", f"s{j}", float(t[i, j])) for i, j in zip(*np.nonzero(t))]
    edges = from_entries(spark, entries + entries[:20], "string")
    for i, j, w in entries[:20]:
        t[int(i[1:]), int(j[1:])] += w
    x, turn = rng.random((90, 3)), rng.random((3, 4))
    ids = spark.createDataFrame([(f"s{i}", *map(float, v)) for i, v in enumerate(x)], "i string, u double, v double, w double")
    places, tasks = packets.dealt(ids, 90)
    assert places.select("b").distinct().count() == 4
    table_ = packets.packed(places.join(ids, "i"), ["u", "v", "w"], tasks)
    both = packets.with_product(table_, turn, packets.matrix(edges, places, tasks), 2, tasks)
    rows = {r["i"]: list(r)[1:] for r in packets.unpacked(both, list("cdefgh"), places).collect()}
    got, y = np.array([rows[f"s{i}"] for i in range(90)]), x @ turn
    assert np.allclose(got, np.concatenate([y, t @ y[:, 2:]], 1), atol=1e-12)
    assert np.allclose(packets.gram(both, 6), got.T @ got) and np.allclose(packets.dots(both, np.eye(6)[:, :2], np.eye(6)[:, 2:]), got[:, :2].T @ got[:, 2:])


def test_the_iteration_writes_packets_once_a_step(spark, monkeypatch):
    """It wrote a row for each state twice a step, and moved a row for each entry."""
    small_packets(monkeypatch)
    t, cut, written = rotating(10, 12), arnoldi.cut, []

    def counted(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(arnoldi, "cut", counted)
    monkeypatch.setattr(arnoldi, "release", lambda df: None)
    basis, r, gap = arnoldi.invariant(table(spark, t), 3)
    rows = [x.count() for x in written]
    assert len(rows) > 10 and sum(rows) <= np.count_nonzero(t) + 120 + np.count_nonzero(t) // 5 + 6 * len(rows) + 120
    x = np.array([row[1:] for row in sorted(basis.collect())])
    assert np.allclose(x.T @ x, np.eye(len(r)), atol=1e-9) and np.linalg.norm(t @ x - x @ r) < 1e-8


class _Reached(Exception):
    pass


@pytest.mark.parametrize("name", ["macrostate_memberships_crisp", "spectral_terminal_states"])
def test_queries_multiply_by_packets(spark, monkeypatch, name):
    """A product of theirs reads a row for each packet or pair of packets; it read one for each state and entry."""

    def reached(table, turn, entries, fresh, tasks):
        assert table.count() == 21 and entries.count() < 4_000
        raise _Reached

    small_packets(monkeypatch)
    monkeypatch.setattr(packets, "ENTRIES", 1_000)
    monkeypatch.setattr(arnoldi, "with_product", reached)
    with pytest.raises(_Reached):
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
