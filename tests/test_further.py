"""States, spectra, velocity models, couplings, walks, lineage geometry, trends and stores against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainframe.functions.special import erfc
from chainframe.operators import chains, flow, kernels, lineages, macrostates, matrix, neighbors, spectral, states, statistics, trends
from chainframe.sources import store
from chainframe.sources.store import from_entries


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.999, 3.0, 4.0, 6.0, 10.0]
    found = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(math.erfc(r["x"]), rel=1e-9, abs=1e-13) for r in found)


def test_correlations_keep_features_without_common_cells(spark):
    x = spark.createDataFrame([(1, "g", 2.0), (2, "g", 3.0), (3, "h", 1.0), (9, "k", 1.0)], "obs long, var string, x double")
    y = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 4.0), (4, "a", 3.0), (1, "b", 5.0), (2, "b", 1.0), (4, "b", 2.0), (3, "b", 0.0)], "obs long, lineage string, y double")
    found = {(r["var"], r["lineage"]): r["corr"] for r in statistics.correlations(x, y, exact=True).collect()}
    dense = {"g": [2, 3, 0, 0], "h": [0, 0, 1, 0]}
    lines = {"a": [1, 2, 4, 3], "b": [5, 1, 0, 2]}
    assert set(found) == set(itertools.product(dense, lines))
    for (v, line), c in found.items():
        assert c == pytest.approx(np.corrcoef(dense[v], lines[line])[0, 1])


def test_harmonic_mean_of_a_zero_is_zero(spark):
    rows = [(o, v, float(1 + (o * v) % 5)) for o in range(1, 9) for v in range(4)] + [(20, 0, 3.0)]
    found = {r["obs"]: r["score"] for r in statistics.cytotrace(spark.createDataFrame(rows, "obs long, var long, x double"), 4, "hmean").collect()}
    assert found[20] == 0 and max(found.values()) == 1


def test_sorted_places(spark):
    rows = [(g, int(v)) for g in range(3) for v in np.random.default_rng(g).permutation(200 * (g + 1))]
    found = statistics.sorted_places(spark.createDataFrame(rows, "g long, v long"), "g", ["v"], "r").collect()
    assert len(found) == len(rows) and all(r["r"] == r["v"] + 1 for r in found)


def test_layers_clusters_and_missing_features(spark):
    layers = spark.createDataFrame([(1, "g", "X", 2.0), (1, "h", "raw", 3.0), (2, "h", "X", 1.0)], "obs long, var string, layer string, x double")
    assert statistics.expression(layers, variables=["h"]).collect() == [(2, "h", 1.0)]
    for bad in (lambda: statistics.expression(layers, "none"), lambda: statistics.expression(layers, variables=["z"]), lambda: statistics.in_clusters(layers, ["q"], "var")):
        with pytest.raises(KeyError):
            bad()
    assert statistics.in_clusters(layers, ["h"], "var").count() == 2
    v = spark.createDataFrame([(1, "g", 1.0), (2, "g", float("nan")), (1, "h", 2.0)], "obs long, var string, v double")
    assert [r["var"] for r in statistics.without_missing(v).collect()] == ["h"]
    with pytest.raises(ValueError):
        statistics.norm_factors(layers, "most")


# ---- velocity models


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x, v, var = rng.standard_normal((12, 5)), rng.standard_normal((12, 5)), rng.random((12, 5)) * 0.05
    v[3] = 0
    links = [(i, int(j)) for i in range(12) for j in rng.permutation([k for k in range(12) if k != i])[:4]]
    edges = from_entries(spark, [(i, j, 1.0) for i, j in links])
    cells = spark.createDataFrame([(i, x[i].tolist(), v[i].tolist(), var[i].tolist()) for i in range(12)], "i long, x array<double>, v array<double>, var array<double>")
    return x, v, var, links, edges, cells


def _probabilities(v, w, scheme, scale):
    w = w - w.mean(1, keepdims=True) if scheme == "correlation" else w
    v = v - v.mean() if scheme == "correlation" else v
    s = w @ v if scheme == "dot" else (w @ v) / (np.linalg.norm(w, axis=1) * np.linalg.norm(v))
    e = np.exp(scale * s - (scale * s).max())
    return e / e.sum()


@pytest.mark.parametrize("scheme", ["dot", "cosine", "correlation"])
def test_stochastic_model_by_differences(cloud, scheme):
    x, v, var, links, edges, cells = cloud
    found = {(r["i"], r["j"]): r["w"] for r in kernels.velocity_stochastic(edges, cells, 5, scheme, 3.0).collect()}
    for i in range(12):
        near = [j for a, j in links if a == i]
        w = x[near] - x[i]
        if i == 3:
            p = np.full(len(near), 1 / len(near))
        else:
            p, h = _probabilities(v[i], w, scheme, 3.0), 1e-4
            for k in range(5):
                step = np.zeros(5)
                step[k] = h
                p = p + (_probabilities(v[i] + step, w, scheme, 3.0) - 2 * _probabilities(v[i], w, scheme, 3.0) + _probabilities(v[i] - step, w, scheme, 3.0)) / h**2 * var[i, k] / 2
            p = p.clip(0, 1)
            p = p / p.sum()
        assert [found.get((i, j), 0.0) for j in near] == pytest.approx(p, abs=2e-5)


def test_monte_carlo_model(cloud):
    x, v, var, links, edges, cells = cloud
    once, again = (sorted(map(tuple, kernels.velocity_monte_carlo(edges, cells, "cosine", 3.0, 40, 5).collect())) for _ in range(2))
    assert [x[:2] for x in once] == [x[:2] for x in again] and [x[2] for x in once] == pytest.approx([x[2] for x in again])
    found = {(i, j): w for i, j, w in once}
    exact = {(r["i"], r["j"]): r["w"] for r in kernels.velocity(edges, cells.select("i", "x", "v"), "cosine", 3.0).collect()}
    assert sum(found.values()) == pytest.approx(12) and all(abs(found[k] - exact[k]) < 0.1 for k in exact if k[0] != 3)
    still = cells.withColumn("var", F.transform("var", lambda y: F.lit(0.0)))
    assert {(r["i"], r["j"]): pytest.approx(r["w"]) for r in kernels.velocity_monte_carlo(edges, still, "cosine", 3.0, 2).collect()} == exact


def test_masked_softmax(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, False), (1, 2, 9.0, True), (1, 3, 1.0, False), (2, 1, 5.0, True)], "i long, j long, s double, m boolean")
    found = {(r["i"], r["j"]): r["w"] for r in rows.select("i", "j", matrix.softmax(F.col("s"), mask=F.col("m")).alias("w")).collect()}
    assert found[1, 2] == 0 and found[2, 1] == 0 and found[1, 1] == pytest.approx(1 / (1 + math.exp(-1)))


def test_times_and_custom_schemes(spark):
    cells = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 4.0)], "i long, t double")
    assert {r["i"]: r["t"] for r in kernels.times_of(cells, "t", True).collect()} == {1: 4, 2: 3, 3: 0}
    with pytest.raises(KeyError):
        kernels.times_of(cells, "u")
    with pytest.raises(ValueError):
        kernels.times_of(cells.withColumn("t", F.when(F.col("i") > 1, F.col("t"))), "t")
    edges = from_entries(spark, [(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0), (2, 3, 3.0)])
    found = {(r["i"], r["j"]): r["w"] for r in kernels.pseudotime(edges, cells, lambda t, others, w: w * (others >= t)).collect()}
    assert found == {(1, 2): 0.5, (1, 3): 0.5, (2, 3): 1.0}


# ---- couplings


def test_couplings(spark):
    cells = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "i long, t int")
    blocks = {(0, 1): [(1, 3, 3.0), (1, 4, 1.0)], (1, 2): [(3, 5, 1.0), (4, 5, 2.0)]}
    made = kernels.couplings_by(lambda a, b: from_entries(spark, blocks[a, b]), list(blocks))
    whole = kernels.complete_couplings(made, cells)
    assert sorted((r["i"], r["j"], r["w"]) for r in whole.collect() if r["src"] == 0) == [(1, 3, 3.0), (1, 4, 1.0), (2, 3, 0.5), (2, 4, 0.5)]
    with pytest.raises(IndexError):
        kernels.complete_couplings(made, cells.filter("i <> 4"))
    graph = from_entries(spark, [(1, 2, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0), (5, 5, 1.0), (1, 3, 9.0)])
    last = cells.filter("t = 2").select("i")
    rows = lambda t: {(r["i"], r["j"]): r["w"] for r in t.collect()}
    assert rows(kernels.real_time(whole, last, None))[5, 5] == 1
    two = cells.filter("t = 1").select("i")
    first = whole.filter("src = 0")
    assert rows(kernels.real_time(first, two, None, self_transitions="uniform")).items() >= {(3, 3): 0.5, (3, 4): 0.5, (4, 3): 0.5, (4, 4): 0.5}.items()
    assert rows(kernels.real_time(first, two, None, self_transitions="connectivities", graph=graph))[3, 4] == 1
    mixed = rows(kernels.real_time(whole, last, None, self_transitions=[0], graph=graph, conn_weight=0.25))
    assert mixed[1, 2] == 0.25 and mixed[1, 3] == pytest.approx(0.75 * 0.75) and mixed[3, 5] == 1 and mixed[5, 5] == 1
    assert all(total == pytest.approx(1) for total in [sum(w for (i, _), w in mixed.items() if i == k) for k in range(1, 6)])


# ---- states and walks


def test_states(spark):
    cells = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(12)], "obs long, label string")
    assert sorted(map(tuple, states.from_names(cells, {"x": [1, 2], "y": [5]}).collect())) == [(1, "x"), (2, "x"), (5, "y")]
    for bad, error in (({"x": [99]}, KeyError), ({"x": [1], "y": [1]}, ValueError), ({"1": [1], 1: [2]}, ValueError)):
        with pytest.raises(error):
            states.from_names(cells, bad)
    with pytest.raises(KeyError):
        states.from_clusters(cells, "label", ["z"])
    hot = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "obs long, p int, q int")
    own = states.from_one_hot(hot, ["p", "q"])
    assert sorted(map(tuple, own.collect())) == [(1, "p"), (3, "q")]
    assert sorted(map(tuple, states.one_hot(own, ["p", "q"]).collect())) == [(1, 1, 0), (3, 0, 1)]
    with pytest.raises(ValueError):
        states.from_one_hot(hot.withColumn("q", F.lit(1)), ["p", "q"]).collect()
    chi = spark.createDataFrame([(k, k / 11, 1 - k / 11) for k in range(12)], "i long, m0 double, m1 double")
    found = states.from_memberships(chi, ["m0", "m1"], 4)
    assert sorted(map(tuple, found.collect())) == [(k, "m1" if k < 4 else "m0") for k in (0, 1, 2, 3, 8, 9, 10, 11)]
    with pytest.raises(ValueError):
        states.from_memberships(chi.withColumn("m1", F.col("m0") - 0.001), ["m0", "m1"], 4)
    assert {r["state"] for r in states.named(found, cells, "label").collect()} == {"a_1", "a_2"}
    with pytest.raises(ValueError):
        states.apart(found, own)
    assert states.apart(found, own, True) is found and states.add(None, own) is own
    assert dict(map(tuple, states.add(own, spark.createDataFrame([(3, "new")], "obs long, state string")).collect())) == {1: "p", 3: "new"}
    assert {r["i"]: r["p"] for r in states.probabilities(found.filter("state = 'm0'"), chi, ["m0", "m1"]).collect()}[11] == 1


def test_walk_specs(spark):
    cells = spark.createDataFrame([(k, "ab"[k % 2], k / 10) for k in range(10)], "obs long, label string, t double")
    ids = lambda spec: sorted(r["obs"] for r in chains.walk_cells(cells, spec).collect())
    assert ids({"label": "a"}) == [0, 2, 4, 6, 8] and ids({"t": (0.5, 0.3)}) == [3, 4, 5] and ids(7) == [7] and ids([1, 2]) == [1, 2] and ids(F.col("t") > 0.75) == [8, 9]
    for bad, error in (({"label": "z"}, ValueError), ({"a": 1, "b": 2}, ValueError), ({"none": 1}, KeyError), ({"t": (1,)}, ValueError)):
        with pytest.raises(error):
            ids(bad)
    assert chains.walk_length(0.25, 10) == 3 and chains.walk_length(5, 10) == 5
    with pytest.raises(ValueError):
        chains.walk_length(0.1, 10)
    starts = chains.walk_starts(cells.filter("obs < 3"), 200, 1).collect()
    assert len(starts) == 200 and {r["obs"] for r in starts} == {0, 1, 2}


# ---- spectra


def _blocks(spark, sizes=(6, 7, 8), leak=0.01):
    """A chain of weakly joined blocks."""
    n = sum(sizes)
    block = np.repeat(range(len(sizes)), sizes)
    t = np.where(block[:, None] == block[None, :], 1.0, leak) + np.random.default_rng(1).random((n, n)) * 0.2 * (block[:, None] == block[None, :])
    t /= t.sum(1, keepdims=True)
    return t, block, from_entries(spark, [(i, j, float(t[i, j])) for i in range(n) for j in range(n)])


@pytest.mark.parametrize("method", ["simplex", "crisp"])
def test_macrostates_recover_blocks(spark, method):
    t, block, edges = _blocks(spark)
    chi, names, coarse = macrostates.macrostates(edges, 3, 30, method)
    found = {r["i"]: [r[n] for n in names] for r in chi.collect()}
    top = np.array([np.argmax(found[i]) for i in range(len(t))])
    assert len({tuple(sorted(set(block[top == k]))) for k in range(3)}) == 3 and all(len(set(block[top == k])) == 1 for k in range(3))
    assert all(min(x) >= 0 and sum(x) == pytest.approx(1) for x in found.values()) and np.allclose(coarse.sum(1), 1) and np.diag(coarse).min() > 0.8
    assert macrostates.coarse_order(names, coarse) == [names[k] for k in np.argsort(-np.diag(coarse), kind="stable")]
    assert sorted(macrostates.coarse_order(names, coarse, "stat_dist")) == sorted(names)


def test_crispness_is_not_below_the_inner_simplex(spark):
    _, _, edges = _blocks(spark, leak=0.15)
    basis, _ = macrostates.invariant_subspace(edges, 3, 30)
    crisp, value = macrostates.optimized_memberships(basis, 3)
    names = ["m0", "m1", "m2"]

    def spread(chi):
        """Trace of the row-normalized Gram matrix of memberships: 1 a state if they are crisp."""
        x = np.array([[r[n] for n in names] for r in chi.collect()])
        return sum((x[:, k] ** 2).sum() / x[:, k].sum() for k in range(3))

    assert 0 < value <= 1 + 1e-9 and spread(crisp) >= spread(macrostates.memberships(basis, 3)) - 1e-6


def test_state_numbers_and_identification():
    values = np.array([1, 0.9 + 0.1j, 0.9 - 0.1j, 0.3])
    assert macrostates.splits_pair(values, 2) and not macrostates.splits_pair(values, 3)
    assert macrostates.states_of(values, 2) == 3 and macrostates.states_of(values, 4) == 4
    with pytest.raises(ValueError):
        macrostates.states_of(values, (1, 3))
    table = macrostates.identification({1: ["A"], 2: None, 3: ["A_1", "A_2", "B"], 4: ["A", "B", "C", "D"]}, ["A", "B", "D"])
    assert table == [(1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 3, 3)] and macrostates.identification_score(table) == pytest.approx(7 / 9)


def test_terminal_state_index(spark):
    t, block, edges = _blocks(spark)
    cells = spark.createDataFrame([(i, "ABC"[b]) for i, b in enumerate(block)], "obs long, label string")
    score, table = macrostates.terminal_state_index(edges, cells, "label", ["A", "B", "C"], 3, 3, 30)
    assert table[2] == (3, 3, 3) and 0.8 <= score <= 1


def test_spectral_terminal_states(spark):
    t, block, edges = _blocks(spark)
    values, vectors = np.linalg.eig(t.T)
    order = np.argsort(-values.real)
    found, left = spectral.eigenvectors(edges, 3, True, 60)
    assert np.allclose(found.real, values.real[order[:3]], atol=1e-6)
    v = {r["i"]: [r["v0"], r["v1"], r["v2"]] for r in left.collect()}
    for k in range(3):
        own, exact = np.array([v[i][k] for i in range(len(t))]), vectors[:, order[k]].real
        assert abs(own @ exact) / (np.linalg.norm(own) * np.linalg.norm(exact)) > 1 - 1e-4
    cells, p = spectral.terminal_states(edges, 3, percentile=50, steps=60)
    rows = cells.collect()
    assert {len({block[r["obs"]] for r in rows if r["state"] == s}) for s in {r["state"] for r in rows}} == {1}
    assert max(r["p"] for r in p.collect()) == pytest.approx(1)
    with pytest.raises(ValueError):
        spectral.terminal_states(edges, 3, percentile=50, steps=5, n_clusters=100)


def test_label_propagation(spark):
    links = [(i, j, 1.0) for base in (0, 10) for i in range(base, base + 5) for j in range(base, base + 5) if i != j] + [(4, 10, 0.1), (10, 4, 0.1)]
    found = {r["i"]: r["cluster"] for r in spectral.propagated(from_entries(spark, links)).collect()}
    assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(10, 15)}) == 1 and found[0] != found[10]


def test_solvers_agree(spark):
    links = [(0, 1, 0.5), (0, 2, 0.5), (1, 0, 0.3), (1, 3, 0.7), (2, 0, 0.9), (2, 4, 0.1), (3, 3, 1.0), (4, 4, 1.0)]
    edges, ends = from_entries(spark, links), spark.createDataFrame([(3, "a"), (4, "b")], "obs long, state string")
    rows = [{r["i"]: r["a"] for r in chains.fate_probabilities(edges, ends, ["a", "b"], tol=1e-9, method=m).collect()} for m in ("auto", "fixed_point")]
    assert rows[0] == pytest.approx(rows[1], abs=1e-6)
    ring = from_entries(spark, [(0, 1, 1.0), (1, 0, 1.0)])
    assert [r["p"] for r in chains.stationary(ring).collect()] == pytest.approx([0.5, 0.5])
    assert chains.irreducible(ring) and not chains.irreducible(edges)


# ---- neighbours, lineages, flows


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_knn_equals_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[5] = x[9] = x[200]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>")
    found = {}
    for r in neighbors.knn(points, 6, block=64, broadcast_bytes=limit).orderBy("i", F.desc(F.round("w", 9)), "j").collect():
        found.setdefault(r["i"], []).append(r["j"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cos, -2)
    assert found == {i: np.argsort(-cos[i], kind="stable")[:6].tolist() for i in range(300)}


def test_lineage_picking():
    names = ["A", "B", "C"]
    assert lineages.resolve(["C", 0, -1, "A"], names) == ["C", "A"] and lineages.resolve(["x", "B"], names, "A", False) == ["A", "B"]
    with pytest.raises(KeyError):
        lineages.resolve(["x"], names)
    with pytest.raises(IndexError):
        lineages.resolve([3], names)


def test_tours():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 6):
        p = rng.random((n, 2))
        d = np.linalg.norm(p[:, None] - p[None], axis=2).tolist()
        length, order = lineages.shortest_tour(d)
        best = min((sum(d[a][b] for a, b in zip((0, *o), (*o, 0))) for o in itertools.permutations(range(1, n))), default=0.0)
        assert sorted(order) == list(range(n)) and order[0] == 0 and length == pytest.approx(best)
    with pytest.raises(ValueError):
        lineages.shortest_tour([[0.0] * 21] * 21)


def test_lineage_rows(spark):
    rng = np.random.default_rng(2)
    p = rng.random((40, 3))
    p /= p.sum(1, keepdims=True)
    fates = spark.createDataFrame([(i, *map(float, r), "xy"[i % 2]) for i, r in enumerate(p)], "i long, a double, b double, c double, label string")
    names = ["a", "b", "c"]
    for how, f in (("sum", np.sum), ("mean", np.mean), ("min", np.min), ("max", np.max), ("std", np.std), ("var", np.var), ("argmin", np.argmin), ("argmax", np.argmax)):
        found = {r["i"]: r[1] for r in lineages.reduce_rows(fates, names, how).collect()}
        assert [found[i] for i in range(40)] == pytest.approx(f(p, axis=1))
        (row,) = lineages.reduce_columns(fates, names, how).collect()
        assert [row[f"{how} of {n}"] for n in names] == pytest.approx(f(p, axis=0))
    assert [list(r)[1:] for r in lineages.sort_rows(fates, names).orderBy("i").collect()] == [pytest.approx(sorted(r)) for r in p]
    assert sum(r["share"] for r in lineages.shares(fates, names, lambda c: F.max(c)).collect()) == pytest.approx(1)
    assert sorted(r["i"] for r in lineages.early_cells(fates, {"label": ["x"]}).collect()) == list(range(0, 40, 2))
    assert lineages.early_cells(fates, [1, 5]).count() == 2 and lineages.early_cells(fates, F.col("a") > 2).count() == 0
    assert lineages.distances(fates, names, lambda a, b: F.sum(F.abs(a - b)))[0][1] == pytest.approx(np.abs(p[:, 0] - p[:, 1]).sum())
    assert lineages.distances(fates, names, np.eye(3)) == np.eye(3).tolist()
    assert sorted(lineages.circular_order(fates, names)) == names and lineages.pick(fates, names, ["a, b"]).columns == ["i", "a or b"]


def test_flow_pieces(spark):
    cells = spark.createDataFrame([(k, "ab"[k % 2], k // 4) for k in range(12)], "i long, cluster string, t int")
    edges = from_entries(spark, [(i, j, 1.0) for i in range(8) for j in range(12) if j // 4 == i // 4 + 1])
    kept, own = flow.restricted(edges, cells, ["a"], [0, 1])
    assert kept.count() == 4 and own.count() == 4
    for bad, error in ((dict(clusters=["z"]), KeyError), (dict(times=[0]), ValueError)):
        with pytest.raises(error):
            flow.restricted(edges, cells, **bad)
    line = spark.createDataFrame([(t, "a", 0.1 * t) for t in range(6)] + [(t, "b", 1 - 0.1 * t) for t in range(6)], "t int, cluster string, share double")
    assert all(r["y"] == pytest.approx(0.1 * r["t"] if r["cluster"] == "a" else 1 - 0.1 * r["t"], abs=1e-6) for r in flow.smoothed_shares(line, 10).collect())


# ---- trends and stores


def test_interval_follows_the_level():
    rng = np.random.default_rng(0)
    x = np.linspace(0, 1, 80)
    y, w, grid = np.sin(4 * x) + rng.normal(0, 0.1, 80), np.ones(80), np.linspace(0, 1, 9)
    widths = []
    for level in (0.5, 0.95, 0.99):
        _, low, high = trends.fit_spline(x, y, w, grid, level=level)
        widths.append(high - low)
    assert np.allclose(widths[0] / widths[1], 0.6744897501960817 / 1.959963984540054) and np.allclose(widths[2] / widths[1], 2.5758293035489004 / 1.959963984540054)
    assert trends.best_penalty(x, y, w, [0.1, 1e6]) == 0.1
    with pytest.raises(ValueError):
        trends.fit_spline(x, y[:5], w, grid)


def test_trends_by_sums(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.random(200)) * 9
    y, w = np.cos(t) + rng.normal(0, 0.1, 200), 0.2 + rng.random(200)
    rows = [("g", "p", float(a), float(b), float(c)) for a, b, c in zip(t, y, w)] + [("h", "p", 1.0, 2.0, 1.0), ("g", "p", None, 1.0, 1.0)]
    found = trends.fit_trends_by_sums(spark.createDataFrame(rows, "var string, lineage string, t double, y double, w double"), 20, level=0.9).collect()
    own = sorted((r["t"], r["y"], r["low"], r["high"]) for r in found if r["var"] == "g")
    grid = np.linspace(t.min(), t.max(), 20)
    mean, low, high = trends.fit_spline(t, y, w, grid, level=0.9)
    assert np.allclose(np.array(own), np.stack([grid, mean, low, high], 1), atol=1e-6)
    assert [r["error"] for r in found if r["var"] == "h"] == ["ValueError: one time only"]


def test_trend_entries(spark):
    rng = np.random.default_rng(1)
    rows = [(v, line, float(t), float(math.sin(t * (1 + (v == "g"))) + rng.normal(0, 0.01)), float(0.5 + t / 10)) for v in ("f", "g", "h") for line in ("p", "q") for t in np.linspace(0, 3, 30)]
    cells = spark.createDataFrame(rows, "var string, lineage string, t double, y double, w double")

    def flat(x, y, w, grid):
        return np.full(len(grid), 7.0), np.full(len(x), 7.0)

    def fails(x, y, w, grid):
        raise ValueError("no fit")

    config = {"f": {"p": flat, "*": None}, "h": fails, "*": None}
    found = trends.fit_trends(cells, 12, model=config, prepare={"g": lambda x, y, w, grid: (x, -y, w, grid), "*": None})
    by = {}
    for r in found.collect():
        by.setdefault((r["var"], r["lineage"]), []).append(r)
    assert {r["y"] for r in by["f", "p"]} == {7.0} and by["h", "q"][0]["error"] == "ValueError: no fit" and by["g", "p"][2]["y"] < 0 < by["f", "q"][2]["y"]
    good = trends.succeeded(found)
    assert {r["var"] for r in good.collect()} == {"f", "g"}
    with pytest.raises(RuntimeError):
        trends.succeeded(found, drop_all_failed=False)
    assert trends.wide(good).columns == ["var", "nth", "p", "q"]
    z = trends.standardized(good.filter("lineage = 'q'")).groupBy("var").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).collect()
    assert all(r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1) for r in z)
    ends = trends.scaled(good.filter("var = 'g'")).agg(F.min("low"), F.max("high")).first()
    assert tuple(ends) == pytest.approx((0, 1))
    with pytest.raises(KeyError):
        trends.chosen({"f": {"p": 1}}, "g", "p")


def test_trend_cells_and_clusters(spark):
    x = spark.createDataFrame([(1, "g", 2.0), (3, "g", 1.0)], "obs long, var string, x double")
    fates = spark.createDataFrame([(k, 0.25, 0.75) for k in range(1, 5)], "i long, a double, b double")
    times = spark.createDataFrame([(k, float(k)) for k in range(1, 5)], "i long, t double")
    assert sorted((r["t"], r["y"]) for r in trends.trend_cells(x, fates, times, ["a", "b"], (1, 3)).filter("lineage = 'b'").collect()) == [(1, 2), (2, 0), (3, 1)]
    assert sorted(r["y"] for r in trends.trend_cells(x, fates, times, ["a"], least=1.5).collect()) == [2]
    curves = spark.createDataFrame([(f"{kind}{k}", float(t), math.sin(t) * (k + 1) if kind == "s" else float(t * (k + 1))) for kind in "sl" for k in range(5) for t in range(8)], "var string, t double, y double").withColumn("lineage", F.lit("a"))
    for options in (dict(neighbours=3), dict(method="kmeans", k=2)):
        found = {r["var"]: r["cluster"] for r in trends.cluster_trends(curves, **options).collect()}
        assert len({found[f"s{k}"] for k in range(5)}) == 1 and len({found[f"l{k}"] for k in range(5)}) == 1 and found["s0"] != found["l0"]


def test_stored_graphs_and_lineages(spark, tmp_path):
    edges = from_entries(spark, [(1, 2, 1.0)])
    fates = spark.createDataFrame([(1, 0.5, 0.5)], "i long, m0 double, m1 double")
    store.save({"connectivities": edges, "own_distances": edges, "T_bwd": edges, "fates": fates}, str(tmp_path), {"fates_names": ["A", "B"]})
    assert store.graph(spark, str(tmp_path)).count() == 1 and store.graph(spark, str(tmp_path), "distances", "own").count() == 1
    assert store.transition_matrix(spark, str(tmp_path), backward=True).count() == 1
    for bad in (lambda: store.graph(spark, str(tmp_path), "distances"), lambda: store.transition_matrix(spark, str(tmp_path)), lambda: store.graph_name(["x"], key="y")):
        with pytest.raises(KeyError):
            bad()
    assert store.graph_name(["own_distances"], "distances", "own") == "own_distances"
    rows, names = store.lineages(spark, str(tmp_path))
    assert names == ["A", "B"] and rows.columns == ["i", "A", "B"]
