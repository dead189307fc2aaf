import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainframe.operators import chains, flow, kernels, labels, lineages, macrostates, matrix, neighbors, statistics, trends
from chainframe.sources.store import from_entries, load, save

CHAIN = {0: {1: 0.8, 2: 0.2}, 1: {0: 0.2, 2: 0.6, 3: 0.2}, 2: {0: 0.6, 1: 0.2, 3: 0.2}, 3: {1: 0.05, 2: 0.05, 4: 0.6, 5: 0.3}, 4: {3: 0.25, 5: 0.25, 6: 0.4, 9: 0.1}, 5: {3: 0.25, 4: 0.25, 6: 0.1, 9: 0.4}, 6: {4: 0.05, 5: 0.05, 7: 0.7, 8: 0.2}, 7: {6: 0.2, 8: 0.8}, 8: {6: 0.8, 7: 0.2}, 9: {4: 0.05, 5: 0.05, 10: 0.7, 11: 0.2}, 10: {9: 0.2, 11: 0.8}, 11: {9: 0.8, 10: 0.2}}
ABSORBING = CHAIN | {3: {1: 0.05, 2: 0.05, 4: 0.45, 5: 0.45}, 7: {7: 1.0}, 10: {10: 1.0}}
LEAKING = CHAIN | {5: {3: 0.25, 4: 0.25, 6: 0.1, 9: 0.3, 12: 0.1}, 12: {12: 0.6, 13: 0.4}, 13: {12: 0.3, 13: 0.7}}


def edges(spark, chain):
    return from_entries(spark, [(i, j, w) for i, row in chain.items() for j, w in row.items()])


def dense(chain):
    out = np.zeros((len(chain), len(chain)))
    for i, row in chain.items():
        for j, w in row.items():
            out[i, j] = w
    return out


@pytest.fixture(scope="module")
def absorbing(spark):
    return edges(spark, ABSORBING).cache(), spark.createDataFrame([(7, "t1"), (10, "t2")], "obs long, state string").cache()


def test_fates_of_the_golden_chain(absorbing):
    expected = {3: 0.5, 4: 0.60571429, 5: 0.39428571, 6: 0.94047619, 8: 0.95238095, 9: 0.05952381, 11: 0.04761905, 7: 1.0, 10: 0.0, 0: 0.5}
    for method in ("fixed_point", "direct"):
        found = {r["i"]: (r["t1"], r["t2"]) for r in chains.fate_probabilities(*absorbing, ["t1", "t2"], tol=1e-6, method=method).collect()}
        assert len(found) == 12
        for i, p in expected.items():
            assert found[i] == pytest.approx((p, 1 - p), abs=1e-4)


def test_absorption_times_of_the_golden_chain(absorbing):
    found = {r["i"]: (r["mean"], r["var"]) for r in chains.absorption_times(*absorbing, steps=150).collect()}
    assert found[0] == pytest.approx((14.743006, 78.799302), abs=1e-2)
    assert found[6] == pytest.approx((2.019322, 5.959332), abs=1e-2) and found[7] == (0, 0)
    given = {r["i"]: (r["mean"], r["var"]) for r in chains.conditional_absorption_times(*absorbing, "t1", ["t1", "t2"], steps=90).collect()}
    assert given[9] == pytest.approx((6.343257, 21.745035), abs=0.05)
    assert given[7] == (0, 0) and given[10][0] == math.inf and math.isnan(given[10][1])


def test_stationary_distribution(spark):
    p = {r["i"]: r["p"] for r in chains.stationary(edges(spark, CHAIN), 120).collect()}
    values, vectors = np.linalg.eig(dense(CHAIN).T)
    v = np.abs(vectors[:, np.argmax(values.real)].real)
    assert np.allclose([p[k] for k in range(12)], v / v.sum(), atol=2e-3) and abs(p[8] - 0.152751) < 2e-3


def test_rare_absorption_is_not_cut_off(spark, monkeypatch):
    from chainframe.plans import queries

    rare = spark.createDataFrame([("view", "view", 0.98), ("view", "purchase", 0.01), ("view", "error", 0.01), ("purchase", "view", 1.0), ("error", "view", 1.0)], "i string, j string, w double")
    monkeypatch.setattr(queries, "event_chain", lambda spark, d: rare)
    of = lambda name: {r["i"]: tuple(r)[1:] for r in queries.QUERIES[name](spark, "").collect()}
    assert of("event_fate_probabilities_direct")["view"] == pytest.approx((0.5, 0.5))
    assert of("event_absorption_times_direct")["view"] == pytest.approx((50, 0.98 / 0.02**2))
    assert of("event_conditional_absorption")["view"] == pytest.approx((50, 0.98 / 0.02**2))
    flip = from_entries(spark, [(0, 1, 1.0), (1, 0, 0.5), (1, 2, 0.5), (2, 1, 1.0)])
    assert {r["i"]: r["p"] for r in chains.stationary(flip, None).collect()} == pytest.approx({0: 0.25, 1: 0.5, 2: 0.25}, abs=1e-6)


def test_whole_vectors_are_read(spark, monkeypatch):
    from chainframe.plans import queries

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 20))
    monkeypatch.setattr(queries, "points", lambda spark, d, dims=None: spark.createDataFrame([(i, x[i].tolist(), i % 2 + 1) for i in range(6)], "i long, x array<double>, label int"))
    monkeypatch.setattr(queries, "graph", lambda spark, d: from_entries(spark, [(i, j, 1.0) for i in range(6) for j in range(6) if i != j]))
    v, body = np.diff(x, axis=1), x[:, :-1]
    score = {(i, j): math.exp(4 * np.corrcoef(v[i], body[j] - body[i])[0, 1]) for i in range(6) for j in range(6) if i != j}
    found = {(r["i"], r["j"]): r["w"] for r in queries.QUERIES["velocity_kernel_correlation_whole"](spark, "").collect()}
    assert found == pytest.approx({(i, j): s / sum(score[i, k] for k in range(6) if k != i) for (i, j), s in score.items()}, abs=2e-6)
    means = {(r["i"], r["k"]): r["mean"] for r in queries.QUERIES["knn_moments_whole"](spark, "").collect()}
    assert means == pytest.approx({(i, k): x[:, k].mean() for i in range(6) for k in range(20)}, abs=2e-6)


def test_classes(spark):
    found = {r["node"]: (r["class"], r["recurrent"]) for r in chains.communicating_classes(edges(spark, LEAKING)).collect()}
    assert found == {k: (0, False) for k in range(12)} | {12: (12, True), 13: (12, True)}
    whole = chains.communicating_classes(edges(spark, CHAIN)).collect()
    assert {(r["class"], r["recurrent"]) for r in whole} == {(0, True)}


def test_components(spark):
    both = edges(spark, CHAIN).union(from_entries(spark, [(12, 12, 0.6), (12, 13, 0.4), (13, 12, 1.0)]))
    assert {r["node"]: r["label"] for r in chains.components(both).collect()} == {k: 0 for k in range(12)} | {12: 12, 13: 12}


def test_random_walks_follow_edges_and_stop(spark, absorbing):
    starts = spark.range(30).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("obs"))
    rows = chains.random_walks(absorbing[0], starts, 12, seed=1, stops=absorbing[1].select("obs")).collect()
    again = chains.random_walks(absorbing[0], starts, 12, seed=1, stops=absorbing[1].select("obs")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = {}
    for walk, step, obs in sorted(map(tuple, rows)):
        by.setdefault(walk, []).append(obs)
    assert len(by) == 30
    for path in by.values():
        assert all(b in ABSORBING[a] for a, b in zip(path, path[1:])) and not {7, 10} & set(path[:-1])


def test_matrix_checks(spark):
    with pytest.raises(ValueError):
        matrix.require_stochastic(from_entries(spark, [(0, 0, 0.5), (1, 0, 1.0)]))
    assert matrix.require_stochastic(edges(spark, CHAIN)).count() == 36
    power = {(r["i"], r["j"]): r["w"] for r in matrix.power(edges(spark, CHAIN), 2).collect()}
    exact = np.linalg.matrix_power(dense(CHAIN), 4)
    assert all(abs(exact[k] - v) < 1e-12 for k, v in power.items())


def weights(k):
    return [round(x, 6) for x in k.weights()]


def test_kernel_algebra(spark):
    a, b, c = (kernels.Kernel(edges(spark, CHAIN)) for _ in range(3))
    assert weights(9 * a + 1 * b) == [0.9, 0.1]
    assert weights(a + b + c) == weights(a + (b + c)) == [round(1 / 3, 6)] * 3
    assert weights(1 * a + 1 * (b + c)) == [0.5, 0.5]
    assert (10 * a).parts[0][0] == 10 and len((a + b * c).kernels()) == 3
    both = {(r["i"], r["j"]): r["w"] for r in (0.8 * a + 0.2 * b).edges().collect()}
    assert both == pytest.approx({(i, j): w for i, row in CHAIN.items() for j, w in row.items()})
    squared = matrix.row_report((a * b).edges()).collect()
    assert all(r["stochastic"] for r in squared)
    for wrong in (0, -1):
        with pytest.raises(ValueError):
            wrong * a
    with pytest.raises(ValueError):
        kernels.Kernel(backward=True) + kernels.Kernel(backward=False)
    with pytest.raises(ValueError):
        (~kernels.Kernel(edges(spark, CHAIN), backward=False)).edges()


def test_couplings_are_stitched(spark):
    rows = [(t, t + 1, 50 * t + k, 50 * (t + 1) + k, 1.0) for t in range(3) for k in range(50)]
    last = spark.range(150, 200).select(F.col("id").alias("i"))
    found = kernels.real_time(spark.createDataFrame(rows, "src int, tgt int, i long, j long, w double"), last).collect()
    assert sorted((r["i"], r["j"]) for r in found) == sorted([(r[2], r[3]) for r in rows] + [(k, k) for k in range(150, 200)])


def test_knn_by_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 5))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "i long, x array<double>")
    found = {}
    for r in neighbors.knn(table, 4, block=25).collect():
        found.setdefault(r["i"], set()).add(r["j"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    assert found == {k: set(np.argsort(-cos[k])[:4].tolist()) for k in range(120)}


FUZZY = [[0.3, 0.7, 0], [0.2, 0.5, 0.3], [0.1, 0.8, 0.1], [0.4, 0.4, 0.2], [0.5, 0.3, 0.2], [0.6, 0.3, 0.1], [0.3, 0.3, 0.4], [0.2, 0.2, 0.6]]


def fate_table(spark, rows, names="abc"):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "i long, " + ", ".join(f"{n} double" for n in names))


def test_discrete_states(spark):
    found = {}
    for r in lineages.discrete(fate_table(spark, FUZZY), ["a", "b", "c"], 2).collect():
        found.setdefault(r["state"], set()).add(r["i"])
    assert found == {"a": {4, 5}, "b": {0, 2}, "c": {6, 7}}


def test_label_mapping(spark):
    cells = spark.createDataFrame(list(zip(range(5), ["b", None, None, "d", "a"], ["a", "b", None, "b", None])), "i int, query string, reference string")
    assert dict(map(tuple, lineages.map_labels(cells).collect())) == {"a": "a_1", "b": "a_2", "d": "b"}


PRIMED = [[0.123459664, 0.129965675, 0.192828002, 0.939402664], [1.05635239, 0.445833459, 2.29080759, 1.90132652], [0.0677880737, 0.0497556864, 1.18428661, 0.202318999], [0.487500398, 1.00657498, 0.0220834882, 0.503008905], [6.27190917, 7.27864781, 1.03978903, 15.5903460], [0.385149269, 0.354765380, 0.177871487, 0.0822138648], [7.06618729, 13.3133671, 1.44904591, 5.79813391], [0.0818005744, 0.536844933, 1.86646162, 2.41141727], [0.144892035, 0.234036215, 0.632392890, 0.0113211403], [0.244926466, 0.250293183, 0.177540208, 0.327240144]]


@pytest.mark.parametrize("method, expected", [("kl_divergence", [0.483980, 0.119383, 1, 0.587562, 0.369469, 0.389531, 0.423538, 0.367353, 0.695330, 0]), ("entropy", [0.594530, 0.182426, 1, 0.425510, 0.362739, 0.177641, 0.276916, 0.515188, 0.615866, 0])])
def test_priming(spark, method, expected):
    names = list("abcd")
    table = lineages.row_normalize(fate_table(spark, PRIMED, names), names)
    found = [r["priming"] for r in lineages.priming(table, names, method).orderBy("i").collect()]
    assert found == pytest.approx(expected, abs=1e-5)


def test_reductions_keep_row_sums(spark):
    table = fate_table(spark, FUZZY).filter("c > 0")
    for measure in ("cosine", "equal", "kl", "js", "scale"):
        rows = lineages.reduce(table, ["a", "b"], ["c"], measure).collect()
        assert all(abs(r["a"] + r["b"] - 1) < 1e-9 for r in rows)


def test_mixing_errors(spark):
    table = fate_table(spark, FUZZY)
    assert lineages.mix(table, list("abc"), ["a, b", "c"]).columns == ["i", "a or b", "c"]
    with pytest.raises(ValueError):
        lineages.mix(table, list("abc"), ["a, b", "b"])
    with pytest.raises(KeyError):
        lineages.mix(table, list("abc"), ["x"])


def test_knots():
    assert trends.knots([3, 5, 4, 0], 3, uniform=True).tolist() == [0, 2.5, 5] and trends.knots([3, 5, 4, 0], 1).tolist() == [5]
    times = [0.0] * 30 + np.linspace(0.1, 0.9, 30).tolist() + [1.0] * 30
    expected = [0, 0.02222222, 0.04444444, 0.06666667, 0.36360153, 0.63639847, 0.93333333, 0.95555556, 0.97777778, 1]
    assert trends.knots(times, 10) == pytest.approx(expected, abs=1e-7)


def test_spline_trends(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.random(300))
    rows = [("g", "l", float(a), float(np.sin(3 * a) + 0.01 * rng.standard_normal()), 1.0) for a in t] + [("bad", "l", None, 1.0, 1.0)]
    found = trends.fit_trends(spark.createDataFrame(rows, "var string, lineage string, t double, y double, w double"), 20).toPandas()
    good = found[found["var"] == "g"]
    assert len(good) == 20 and np.abs(good["y"] - np.sin(3 * good["t"])).max() < 0.03 and (good["low"] <= good["high"]).all()
    assert found[found["var"] == "bad"]["error"].str.contains("no cells").all()
    basis = trends.basis(np.linspace(0, 1, 50), np.array([0.0, 0.5, 1.0]))
    assert np.allclose(basis.sum(1), 1)


def test_correlation_and_q_values(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((40, 6)) * (rng.random((40, 6)) < 0.6), rng.random(40)
    long = spark.createDataFrame([(k, f"g{v}", float(x[k, v])) for k in range(40) for v in range(6) if x[k, v]], "obs int, var string, x double")
    fate = spark.createDataFrame([(k, "l", float(y[k])) for k in range(40)], "obs int, lineage string, y double")
    table = statistics.fisher(statistics.correlations(long, fate)).toPandas().set_index("var")
    p = []
    for v in range(6):
        r = np.corrcoef(x[:, v], y)[0, 1] * 40 / 39
        assert table["corr"][f"g{v}"] == pytest.approx(r)
        p.append(math.erfc(abs(math.atanh(r) * math.sqrt(37)) / math.sqrt(2)))
    assert [table["pval"][f"g{v}"] for v in range(6)] == pytest.approx(p)
    order, q = np.argsort(p), np.zeros(6)
    low = 1.0
    for rank in range(6, 0, -1):
        low = min(low, p[order[rank - 1]] * 6 / rank)
        q[order[rank - 1]] = low
    assert [table["qval"][f"g{v}"] for v in range(6)] == pytest.approx(q)


def test_blocks_give_macrostates(spark):
    rows = []
    for block in range(3):
        for a in range(6):
            for b in range(6):
                rows.append((6 * block + a, 6 * block + b, 0.97 / 6))
            rows.append((6 * block + a, 6 * ((block + 1) % 3) + a, 0.03))
    chi, names, coarse = macrostates.macrostates(from_entries(spark, rows), 3, 20)
    best = {}
    for r in chi.collect():
        p = [r[n] for n in names]
        assert abs(sum(p) - 1) < 1e-9 and min(p) >= 0
        best.setdefault(r["i"] // 6, set()).add(int(np.argmax(p)))
    assert all(len(v) == 1 for v in best.values()) and len(set.union(*best.values())) == 3
    assert np.allclose(coarse.sum(1), 1, atol=1e-6) and np.diag(coarse).min() > 0.9
    assert macrostates.terminal(names, coarse, threshold=0.9) == names and macrostates.eigengap(np.array([1, 0.97, 0.96, 0.1])) == 2


def test_times_and_labels(spark):
    cells = spark.createDataFrame([(1, 0.0, "a"), (2, 2.0, "b"), (3, 5.0, "c"), (4, 5.0, None)], "i int, t double, label string")
    assert [r["t"] for r in labels.inverted_time(cells).orderBy("i").collect()] == [5, 3, 0, 0]
    assert dict(map(tuple, labels.unit_gaps(cells).collect())) == {0: 0, 2: 1, 5: 2.5}
    assert sorted(map(tuple, labels.level_pairs(cells, "all").collect())) == [(0, 2), (0, 5), (2, 5)]
    assert [r["label"] for r in labels.combine(cells, "label", ["a, b"]).orderBy("i").collect()] == ["a or b", "a or b", None, None]
    near = flow.nearest_in_time(cells.select("t", F.col("i").alias("v")), spark.createDataFrame([(1.0,), (3.0,), (9.0,), (-1.0,)], "g double"))
    assert {r["g"]: r["t"] for r in near.collect()} == {1.0: 2.0, 3.0: 2.0, 9.0: 5.0, -1.0: 0.0}
    with pytest.raises(ValueError):
        labels.numeric_time(cells.limit(1), "t")


def test_save_and_load(spark, tmp_path):
    save({"t": edges(spark, CHAIN)}, str(tmp_path / "k"), {"kind": "x"})
    tables, params = load(spark, str(tmp_path / "k"), ["t", "absent"])
    assert params == {"kind": "x"} and list(tables) == ["t"] and tables["t"].count() == 36
