"""Connected components of an undirected edge table, by alternating star contractions.

Each round hangs every neighbour of a node on the smallest of them, first the larger
neighbours and then the smaller ones, until every node hangs on the smallest node of its
component. Rounds grow with the logarithm of the component size, all state is an edge
table in shared storage, and a hub's edges are only aggregated with map-side combine and
joined (adaptive skew splitting), never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.lineage import cut, release


def _hang(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a < b). Larger: each u's neighbours above u go to min(N(u), u). Smaller: u and its neighbours below u go to their least."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.filter("a < b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) for each node of an edge table (a, b): label is the component's smallest node.

    Self-loops and repeated edges count for nothing (a node with only self-loops is not listed);
    edges with a null end are ignored. An empty table gives an empty result.
    """
    state = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    state, before = cut(state), None
    for _ in range(max_rounds):
        old, state = state, cut(_hang(_hang(state, True), False))
        release(old)
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("b").alias("node"), F.col("a").alias("label")).union(state.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def strong_components(edges: list[tuple]) -> dict:
    """The strongly connected component of each node of a small directed graph, as one of its nodes. Depth-first search with a stack of its own."""
    ahead: dict = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number, low, held, root = {}, {}, [], {}
    for start in ahead:
        if start in number:
            continue
        work = [(start, iter(ahead[start]))]
        number[start] = low[start] = len(number)
        held.append(start)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    held.append(other)
                    work.append((other, iter(ahead[other])))
                    break
                if other not in root:
                    low[node] = min(low[node], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    while True:
                        member = held.pop()
                        root[member] = node
                        if member == node:
                            break
    return root
