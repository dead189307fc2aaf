"""Communities of greatest modularity, with a resolution: local moving, splitting into connected parts, contraction, level by level."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.lineage import release, stored
from chainframe.linalg.components import connected_components
from chainframe.operators.neighbors import symmetrize

#: Edges of a block of communities, which a task holds.
EDGES = 800_000


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (i, c) of a graph whose edges (i, j, w) stand both ways, loops once: the share of weight inside less resolution times what chance would put there."""
    named = edges.join(labels, "i").join(labels.select(F.col("i").alias("j"), F.col("c").alias("d")), "j")
    total, inside = named.agg(F.sum("w"), F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0))).first()
    square = named.groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") ** 2)).first()[0]
    return (inside - resolution * square / total) / total if total else 0.0


def _movers(edges: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """(i, c, edges): the nodes that gain by moving from their community c to one that they have an edge into, and how many edges they have; state is (i, c, k, mass)."""
    theirs = state.select(F.col("i").alias("j"), F.col("c").alias("d"), F.col("mass").alias("theirs"))
    into = edges.filter("i <> j").join(theirs, "j").groupBy("i", "d").agg(F.sum("w").alias("w"), F.count("*").alias("edges"), F.max("theirs").alias("theirs")).join(state, "i")
    gain = F.col("w") - resolution * F.col("k") * (F.col("theirs") - F.col("mass") + F.col("k")) / total
    best = into.groupBy("i", "c").agg(F.max(F.when(F.col("c") != F.col("d"), gain)).alias("gain"), F.coalesce(F.max(F.when(F.col("c") == F.col("d"), F.col("w"))), F.lit(0.0)).alias("kept"), F.sum("edges").alias("edges"))
    return best.filter(F.col("gain") - F.col("kept") > 1e-12 * total).select("i", "c", "edges")


def _settled(total: float, resolution: float) -> Callable[[pa.Table], pa.Table]:
    """Of one block, the edges (i, j, w) of nodes that may move, with i's community, weight and its mass and j's: (i, d), new communities, when none of the nodes gains any more."""

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("i", "ascending"), ("j", "ascending")])
        starts, ends, weights, c, k, mass, d, theirs = (rows[n].to_pylist() for n in ("i", "j", "w", "c", "k", "mass", "d", "theirs"))
        place, mass, size, near = dict(zip(ends, d)) | dict(zip(starts, c)), dict(zip(d, theirs)) | dict(zip(c, mass)), dict(zip(starts, k)), {}
        for i, j, w in zip(starts, ends, weights):
            near.setdefault(i, []).append((j, w))
        before, moved = {i: place[i] for i in near}, True
        while moved:  # over all nodes, then over neighbours of those that moved, until a turn over all moves none
            moved, queue, waiting = False, deque(near), set(near)
            while queue:
                i = queue.popleft()
                waiting.discard(i)
                own, into = place[i], {}
                for j, w in near[i]:
                    into[place[j]] = into.get(place[j], 0.0) + w
                kept, best, most = into.pop(own, 0.0), own, 1e-12 * total
                for to, w in into.items():
                    gain = w - kept - resolution * size[i] * (mass[to] - mass[own] + size[i]) / total
                    if gain > most or (gain == most and to < best != own):
                        best, most = to, gain
                if best != own:
                    moved, place[i] = True, best
                    mass[own] -= size[i]
                    mass[best] += size[i]
                    again = [j for j, _ in near[i] if j in near and j not in waiting and place[j] != best]
                    queue.extend(again)
                    waiting.update(again)
        new = [(i, place[i]) for i in near if place[i] != before[i]]
        return pa.table({"i": pa.array([x[0] for x in new], rows["i"].type), "to": pa.array([x[1] for x in new], rows["c"].type)})

    return settle


def _massed(labels: DataFrame) -> DataFrame:
    """(i, c, k, mass): the weight of each community beside its nodes'."""
    return labels.join(labels.groupBy("c").agg(F.sum("k").alias("mass")), "c").select("i", "c", "k", "mass")


def _local(edges: DataFrame, strength: DataFrame, total: float, resolution: float, most: int, block: int) -> DataFrame:
    """(i, c): nodes moved, each from a community of its own, until none gains.

    Communities are dealt to blocks anew in each turn, and nodes move between those of one block, one after the other, in a task that has all it needs to know of
    these: so gains of different blocks add up, and modularity never falls. Only nodes that may gain are moved; a block has at most some `block` of their edges, the
    other nodes wait for a turn.
    """
    edges = edges.filter("i <> j")
    kind = edges.schema["i"].dataType.simpleString()
    count = edges.count()
    state = stored(strength.select("i", F.col("i").alias("c"), "k", F.col("k").alias("mass")))
    for turn in range(most):
        ask, blocks, share = edges, 1, 1.0
        if count > block:
            movers = stored(_movers(edges, state, total, resolution))
            spread = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(blocks))  # noqa: B023, E731
            waiting = movers.agg(F.sum("edges")).first()[0] or 0
            blocks = math.ceil(math.sqrt(waiting / block))  # of a block's edges, as many lead out of it as there are blocks
            if not blocks:
                release(movers)
                return state.select("i", "c")
            fullest = movers.groupBy(spread(F.col("c"))).agg(F.sum("edges").alias("n")).agg(F.max("n")).first()[0]
            share = min(1.0, block / fullest)
            ask = edges.join(movers.filter(F.pmod(F.xxhash64(F.lit(turn), F.lit("share"), "i"), F.lit(1_000_003)) < share * 1_000_003).select("i"), "i", "left_semi")
        theirs = state.select(F.col("i").alias("j"), F.col("c").alias("d"), F.col("mass").alias("theirs"))
        named = ask.join(state, "i").join(theirs, "j")
        b = F.lit(0) if blocks == 1 else spread(F.col("c"))
        inside = named.withColumn("b", b).filter(F.lit(True) if blocks == 1 else F.col("b") == spread(F.col("d")))
        moves = stored(inside.select("b", "i", "j", "w", "c", "k", "mass", "d", "theirs").groupBy("b").applyInArrow(_settled(total, resolution), f"i {kind}, to {kind}"))
        new = stored(_massed(state.join(moves, "i", "left").select("i", F.coalesce("to", "c").alias("c"), "k")))
        still = blocks == 1 and share == 1 and (count <= block or moves.isEmpty())  # all is settled, or the rest are gains by rounding
        release(moves)
        release(state)
        if count > block:
            release(movers)
        state = new
        if still:
            return state.select("i", "c")
    raise RuntimeError(f"communities did not settle in {most} turns")


def _connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each community's connected parts as communities, named by their smallest node; that is never a loss."""
    inner = edges.join(labels, "i").join(labels.select(F.col("i").alias("j"), F.col("c").alias("d")), "j").filter("c = d AND i < j AND w > 0")
    parts = connected_components(inner.select(F.col("i").alias("a"), F.col("j").alias("b"))).select(F.col("node").alias("i"), F.col("label").alias("part"))
    return labels.join(parts, "i", "left").select("i", F.coalesce("part", "i").alias("c"))


def communities(edges: DataFrame, resolution: float = 1.0, most: int = 500, levels: list | None = None, block: int = EDGES) -> DataFrame:
    """(i, cluster): communities of a graph (i, j, w) with numbers as ids, numbered from 0 by size, then by smallest node.

    Each pair has the larger of its two weights, and weights aren't negative. A level moves nodes between communities while modularity grows, splits communities that
    are not connected, and contracts each to a node of the next level; it ends when a level changes nothing. Modularity never falls
    (`levels`, a list, gets its value after each level), and every community is connected. A higher resolution gives smaller communities.
    """
    level = stored(symmetrize(edges.filter("w > 0")))
    place = stored(level.select("i").distinct().select("i", F.col("i").alias("c")))
    total = level.agg(F.sum("w")).first()[0]
    if not total:
        return place.select("i", F.lit(0).alias("cluster")).limit(0)
    last = modularity(level, place, resolution)
    for _ in range(most):
        strength = level.groupBy("i").agg(F.sum("w").alias("k"))
        labels = _local(level, strength, total, resolution, most, block)
        labels = stored(_connected(level, labels))
        now = modularity(level, labels, resolution)
        if levels is not None:
            levels.append(now)
        if now <= last + 1e-12:
            break
        last = now
        above = labels.select(F.col("i").alias("c"), F.col("c").alias("up"))
        old, place = place, stored(place.join(above, "c").select("i", F.col("up").alias("c")))
        release(old)
        joined = level.join(labels.withColumnRenamed("c", "a"), "i").join(labels.select(F.col("i").alias("j"), F.col("c").alias("b")), "j")
        level = stored(joined.groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("w").alias("w")))
    sizes = place.groupBy("c").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    numbered = sizes.select("c", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("cluster"))  # a row for each community
    return place.join(numbered, "c").select("i", "cluster")
