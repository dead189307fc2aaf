import numpy as np
import pytest

from chainframe.operators.communities import _local, communities, modularity
from chainframe.operators.neighbors import symmetrize
from chainframe.sources.store import from_entries


def planted(spark, sizes, inside, outside, seed=1):
    rng = np.random.default_rng(seed)
    block = np.repeat(np.arange(len(sizes)), sizes)
    n = len(block)
    t = np.triu(rng.random((n, n)) < np.where(block[:, None] == block, inside, outside), 1)
    return block, t | t.T, from_entries(spark, [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(t))])


def score(t, c, resolution=1.0):
    k, total = t.sum(1), t.sum()
    same = c[:, None] == c
    return (t * same).sum() / total - resolution * (np.outer(k, k) * same).sum() / total**2


def test_planted_blocks_are_found_and_modularity_never_falls(spark):
    block, t, edges = planted(spark, [14, 10, 8], 0.8, 0.04)
    levels = []
    found = {r["i"]: r["cluster"] for r in communities(edges, levels=levels).collect()}
    c = np.array([found[i] for i in range(len(block))])
    assert (c == block).all()  # numbered by size
    assert levels == sorted(levels) and levels[-1] == pytest.approx(score(t, c))
    labels = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(c)], "i long, c long")
    both = edges.unionByName(edges.selectExpr("j AS i", "i AS j", "w"))
    assert modularity(both, labels, 1.3) == pytest.approx(score(t, c, 1.3))
    # each community is connected
    for k in set(c.tolist()):
        own = np.flatnonzero(c == k)
        reach = np.linalg.matrix_power(t[np.ix_(own, own)].astype(int) + np.eye(len(own), dtype=int), len(own)) > 0
        assert reach.all()


def test_resolution_empty_graphs_and_parts(spark):
    ring = from_entries(spark, [(i, (i + 1) % 12, 1.0) for i in range(12)])
    few, many = (communities(ring, r).agg({"cluster": "max"}).first()[0] for r in (0.3, 2.5))
    assert few < many
    assert not communities(ring.limit(0)).collect()
    apart = {r["i"]: r["cluster"] for r in communities(from_entries(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (7, 8, 1.0)]), 0.01).collect()}
    assert apart[0] == apart[1] == apart[2] == 0 and apart[7] == apart[8] == 1


def gains(t, c):
    """The best gain of a move of each node into a community that it has an edge into."""
    k, total = t.sum(1), t.sum()
    into = np.stack([t[:, c == x].sum(1) for x in range(c.max() + 1)], 1)
    mass = np.array([k[c == x].sum() for x in range(c.max() + 1)])
    own = into[np.arange(len(c)), c]
    gain = into - own[:, None] - k[:, None] * (mass[None, :] - mass[c][:, None] + k[:, None]) / total
    gain[(into == 0) | (np.arange(c.max() + 1)[None, :] == c[:, None])] = -np.inf
    return gain.max(1)


def noisy(spark):
    return planted(spark, [30, 30, 30, 30], 0.3, 0.05, seed=4)


@pytest.mark.parametrize("block", [200_000, 300])
def test_a_level_settles_in_few_turns_and_no_node_gains(spark, block):
    """One turn if all edges are one block's; in blocks of 300 edges (the graph has some 1,400 both ways) some more."""
    block_of, t, edges = noisy(spark)
    level = symmetrize(edges).cache()
    strength = level.groupBy("i").agg({"w": "sum"}).toDF("i", "k")
    found = {r["i"]: r["c"] for r in _local(level, strength, float(t.sum()), 1.0, 1 if block > 300 else 60, block).collect()}
    names = {x: n for n, x in enumerate(sorted(set(found.values())))}
    c = np.array([names[found[i]] for i in range(len(t))])
    assert gains(t, c).max() <= 1e-9 * t.sum() and score(t, c) > 0.2


def test_communities_of_a_noisy_graph_in_few_turns(spark):
    block_of, t, edges = noisy(spark)
    levels = []
    found = {r["i"]: r["cluster"] for r in communities(edges, most=8, levels=levels).collect()}
    c = np.array([found[i] for i in range(len(t))])
    assert levels == sorted(levels) and levels[-1] == pytest.approx(score(t, c)) and levels[-1] > score(t, block_of) - 0.02
