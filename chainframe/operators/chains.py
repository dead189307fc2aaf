"""Analysis of a transition matrix: absorption, stationary distribution, communicating classes, random walks.

Absorption quantities all solve X = Q X + B, by a Krylov iteration over tables that ends by its residual, or directly on the
driver if there are few states.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.lineage import cut, release, stored
from chainframe.linalg.components import connected_components, strong_components
from chainframe.linalg.dense import stationary_from_uniform
from chainframe.linalg.krylov import fixed_point, gmres
from chainframe.operators.statistics import sorted_places

#: Transient states up to which a system may be solved densely on the driver.
DIRECT_STATES = 2_000
#: States up to which a stationary distribution is found by elimination on the driver.
ELIMINATED = 1_000


def split(edges: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transient-to-transient entries Q, and S (i, state, w), one-step probabilities into each recurrent state (obs, state)."""
    keys = states.select(F.col("obs").alias("i"))
    moving = edges.join(keys, "i", "left_anti")
    q = moving.join(keys.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "w")
    s = moving.join(states.select(F.col("obs").alias("j"), "state"), "j").groupBy("i", "state").agg(F.sum("w").alias("w"))
    return q, s


def _dense(edges: DataFrame, at: dict) -> np.ndarray:
    """A small matrix on the driver: at most DIRECT_STATES rows and columns."""
    found = edges.select("i", "j", "w").toArrow()
    out = np.zeros((len(at), len(at)))
    rows, columns = ([at[x] for x in found[c].to_pylist()] for c in ("i", "j"))
    np.add.at(out, (rows, columns), found["w"].to_numpy())
    return out


def solve_direct(q: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The same by dense elimination on the driver, for at most DIRECT_STATES transient states."""
    rows = b.limit(DIRECT_STATES + 1).toPandas()
    if len(rows) > DIRECT_STATES:
        raise ValueError("too many states for a direct solution")
    at = {k: n for n, k in enumerate(rows["i"])}
    a, right = np.eye(len(rows)) - _dense(q, at), rows[columns].to_numpy(float)
    x = np.linalg.solve(a, right) if len(rows) else np.zeros((0, len(columns)))
    x = x + np.linalg.solve(a, right - a @ x) if len(rows) else x
    kind = b.schema["i"].dataType.simpleString()
    return b.sparkSession.createDataFrame(pd.DataFrame({"i": rows["i"], **{c: x[:, k] for k, c in enumerate(columns)}}), f"i {kind}, " + ", ".join(f"{c} double" for c in columns))


def _small(states: DataFrame, most: int = DIRECT_STATES) -> bool:
    return states.limit(most + 1).count() <= most


def _solver(method: str, steps: int | None, tol: float):
    """How X = Q X + B is solved: "direct" on the driver, "krylov" by restarted GMRES over tables, "fixed_point" by repetition; "auto" is direct
    for at most DIRECT_STATES states, else krylov, and both are right to well below the tolerances of use. Given steps are plain repetition."""
    if method not in ("auto", "direct", "krylov", "fixed_point"):
        raise ValueError("method is auto, direct, krylov or fixed_point")

    def solved(q: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
        if steps is not None or method == "fixed_point":
            return fixed_point(q, b, columns, steps, tol)
        if method == "direct" or method == "auto" and _small(b):
            return solve_direct(q, b, columns)
        return gmres(q, b, columns, tol)

    return solved


def fate_probabilities(edges: DataFrame, states: DataFrame, names: list[str], steps: int | None = None, tol: float = 1e-10, method: str = "auto") -> DataFrame:
    """(i, one column for each named state): the chance that a walk from i ends in that state; 1 on own recurrent cells.

    States that aren't named make their cells transient. For method and steps see `_solver`; an iteration ends by its residual, tol times the
    right-hand side, or raises.
    """
    states = states.filter(F.col("state").isin(names))
    q, s = split(edges, states)
    transient = edges.select("i").distinct().join(states.select(F.col("obs").alias("i")), "i", "left_anti")
    wide = s.groupBy("i").agg(*[F.sum(F.when(F.col("state") == n, F.col("w")).otherwise(0.0)).alias(n) for n in names])
    b = transient.join(wide, "i", "left").fillna(0.0, names)
    x = _solver(method, steps, tol)(q, b, names)
    own = states.select(F.col("obs").alias("i"), *[(F.col("state") == n).cast("double").alias(n) for n in names])
    return x.unionByName(own)


def _moments(q: DataFrame, leave: DataFrame, transient: DataFrame, solved) -> DataFrame:
    """(i, mean, var) of the steps until a walk leaves: m = 1 + Q m, and v = u + Q v with u the variance that one step adds,
    sum_j q_ij (1 + m_j - m_i)^2 + l_i (1 - m_i)^2, a sum of squares, so v is never negative. leave is (i, l)."""
    m = cut(solved(q, transient.select("i", F.lit(1.0).alias("mean")), ["mean"]))
    ends = m.select(F.col("i").alias("j"), F.col("mean").alias("next"))
    within = q.join(m, "i").join(ends, "j").groupBy("i").agg(F.sum(F.col("w") * (1 + F.col("next") - F.col("mean")) ** 2).alias("within"))
    out = F.coalesce(F.col("l"), F.lit(0.0)) * (1 - F.col("mean")) ** 2
    u = m.join(within, "i", "left").join(leave, "i", "left").select("i", (F.coalesce("within", F.lit(0.0)) + out).alias("var"))
    return m.join(solved(q, u, ["var"]), "i").select("i", "mean", "var")


def absorption_times(edges: DataFrame, states: DataFrame, steps: int | None = None, tol: float = 1e-10, method: str = "auto") -> DataFrame:
    """(i, mean, var) of the steps until any recurrent cell; 0 on recurrent cells."""
    q, s = split(edges, states)
    transient = edges.select("i").distinct().join(states.select(F.col("obs").alias("i")), "i", "left_anti")
    moments = _moments(cut(q), s.groupBy("i").agg(F.sum("w").alias("l")), transient, _solver(method, steps, tol))
    return moments.unionByName(states.select(F.col("obs").alias("i"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var")))


def conditional_absorption_times(edges: DataFrame, states: DataFrame, name: str, names: list[str], steps: int | None = None, tol: float = 1e-10, method: str = "auto") -> DataFrame:
    """(i, mean, var) of the steps to state `name` given that it is reached: with h its fate probability, those of the chain with steps q_ij h_j / h_i.

    0 on its own cells; infinite mean and NaN variance on cells of other states and where h is 0.
    """
    states = states.filter(F.col("state").isin(names))
    q, s = split(edges, states)
    fate = cut(fate_probabilities(edges, states, names, steps, tol, method).select("i", F.col(name).alias("h")))
    moving = cut(fate.join(states.select(F.col("obs").alias("i")), "i", "left_anti"))
    able = moving.filter("h > 0")
    given = cut(q.join(able, "i").join(able.select(F.col("i").alias("j"), F.col("h").alias("hj")), "j").select("i", "j", (F.col("w") * F.col("hj") / F.col("h")).alias("w")))
    leave = s.filter(F.col("state") == name).join(able, "i").select("i", (F.col("w") / F.col("h")).alias("l"))
    found = _moments(given, leave, able, _solver(method, steps, tol))
    never = moving.filter("h = 0").select("i", F.lit(float("inf")).alias("mean"), F.lit(float("nan")).alias("var"))
    own = F.col("state") == name
    return found.unionByName(never).unionByName(states.select(F.col("obs").alias("i"), F.when(own, 0.0).otherwise(F.lit(float("inf"))).alias("mean"), F.when(own, 0.0).otherwise(F.lit(float("nan"))).alias("var")))


def _after(edges: DataFrame, steps: int, every: int = 10) -> DataFrame:
    """(i, p): a uniformly drawn state after that many steps."""
    ids, edges = cut(edges.select("i").distinct()), cut(edges)
    p = cut(ids.withColumn("p", F.lit(1.0) / F.lit(ids.count())))
    for k in range(1, steps + 1):
        moved = edges.join(p, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("w") * F.col("p")).alias("p"))
        p = ids.join(moved, "i", "left").fillna(0.0, ["p"])
        if k % every == 0:
            p = cut(p)
    return p


def _visits(edges: DataFrame, starts: DataFrame, tol: float) -> DataFrame:
    """(i, x): x = s + x Q, the visits of a walk that begins by starts (i, x), which lists all states, and ends where edges lead elsewhere."""
    back = edges.join(starts.select("i"), "i", "left_semi").join(starts.select(F.col("i").alias("j")), "j", "left_semi")
    return gmres(back.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"), starts, ["x"], tol)


def stationary(edges: DataFrame, steps: int | None = None, tol: float = 1e-9, method: str = "auto") -> DataFrame:
    """(i, p): where a walk from a uniformly drawn state is in the long run, so periodic chains have one too, and a chain with several closed classes gets each one's
    distribution by the chance to end in it.

    At most ELIMINATED states ("direct") are eliminated one by one on the driver, without subtractions, so slow mixing costs no digit. Larger chains
    ("krylov") are taken apart into classes; in each closed one a state is picked, the visits to all others between two visits to it solve one linear system, and
    the result is checked: |p T - p| is at most tol, summed over all states, or an error is raised. Given steps are plain ones, with no check.
    """
    if method not in ("auto", "direct", "krylov"):
        raise ValueError("method is auto, direct or krylov")
    if steps is not None:
        return _after(edges, steps)
    ids = cut(edges.select("i").distinct())
    if method == "direct" or method == "auto" and _small(ids, ELIMINATED):
        names = sorted(ids.toPandas()["i"].tolist())
        p = stationary_from_uniform(_dense(edges, {k: n for n, k in enumerate(names)}))
        return edges.sparkSession.createDataFrame(pd.DataFrame({"i": names, "p": p}), f"i {ids.schema['i'].dataType.simpleString()}, p double")
    edges = cut(edges.filter("w > 0").select("i", "j", "w"))
    n = ids.count()
    classes = communicating_classes(edges.unionByName(ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))))
    members = cut(classes.filter("recurrent").select(F.col("node").alias("i"), "class"))
    weight = edges.filter("i <> j").groupBy(F.col("j").alias("i")).agg(F.sum("w").alias("in"))
    roots = cut(members.join(weight, "i", "left").groupBy("class").agg(F.max_by("i", F.struct(F.coalesce("in", F.lit(0.0)), F.hash("i"), "i")).alias("i")))
    others = members.join(roots.select("i"), "i", "left_anti")
    first = edges.join(roots, "i").select(F.col("j").alias("i"), F.col("w").alias("x"))
    starts = cut(others.join(first, "i", "left").groupBy("i").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x")))
    x = roots.select("i", F.lit(1.0).alias("x"))
    if not starts.isEmpty():
        x = x.unionByName(_visits(edges, starts, tol * 1e-3))
    x = cut(x.join(members, "i"))
    passing = cut(ids.join(members.select("i"), "i", "left_anti").withColumn("x", F.lit(1.0)))
    share = members.groupBy("class").agg(F.count("*").cast("double").alias("mass"))
    if not passing.isEmpty():
        met = _visits(edges, passing, tol * 1e-3)
        come = met.join(edges, "i").join(members.withColumnRenamed("i", "j"), "j").groupBy("class").agg(F.sum(F.col("x") * F.col("w")).alias("come"))
        share = share.join(come, "class", "left").select("class", (F.col("mass") + F.coalesce("come", F.lit(0.0))).alias("mass"))
    total = x.groupBy("class").agg(F.sum("x").alias("total")).join(share, "class")
    p = x.join(total, "class").select("i", (F.col("x") / F.col("total") * F.col("mass") / n).alias("p"))
    p = cut(ids.join(p, "i", "left").fillna(0.0, ["p"]))
    moved = edges.join(p, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("w") * F.col("p")).alias("q"))
    left = p.join(moved, "i", "left").agg(F.sum(F.abs(F.col("p") - F.coalesce("q", F.lit(0.0))))).first()[0]
    if left > tol:
        raise RuntimeError(f"the distribution found moves by {left:.3g} a step")
    return p


def components(edges: DataFrame) -> DataFrame:
    """(node, label) by undirected connectivity; label is the smallest node."""
    return connected_components(edges.filter("w <> 0").select(F.col("i").alias("a"), F.col("j").alias("b")))


def _meeting(edges: DataFrame, nodes: DataFrame, seed: int, max_rounds: int) -> DataFrame:
    """(node, f, b): of the nodes that each can reach, and of those that reach it, the one of least hash.

    A round takes what a node's neighbours know, and what the node that it knows knows (which it reaches too), so what is
    known grows by a factor a round where paths are long. Tables are kept as files, since checkpoints carry on what the optimizer infers of
    their columns, which doubles with each round.
    """
    known = kept = stored(nodes.select("node", *[F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node").alias("n")).alias(c) for c in ("f", "b")]))
    for _ in range(max_rounds):
        near = {c: edges.join(known.select(F.col("node").alias(to), F.col(c).alias("x")), to).groupBy(F.col(at).alias("node")).agg(F.min("x").alias(f"near_{c}")) for c, at, to in (("f", "i", "j"), ("b", "j", "i"))}
        far = {c: known.select(F.col("node").alias(f"at_{c}"), F.col(c).alias(f"far_{c}")) for c in ("f", "b")}
        new = known.join(near["f"], "node", "left").join(near["b"], "node", "left")
        for c in ("f", "b"):
            new = new.join(far[c], F.col(f"{c}.n") == F.col(f"at_{c}"), "left")
        least = lambda c: F.least(c, F.coalesce(f"near_{c}", c), F.coalesce(f"far_{c}", c))
        new = stored(new.select("node", least("f").alias("nf"), least("b").alias("nb"), "f", "b"))
        release(kept)
        known, kept = new.select("node", F.col("nf").alias("f"), F.col("nb").alias("b")), new
        if new.filter("nf <> f OR nb <> b").isEmpty():
            return known.select("node", F.col("f.n").alias("f"), F.col("b.n").alias("b"))
    raise RuntimeError("reachability did not settle")


def communicating_classes(edges: DataFrame, max_rounds: int = 1_000, finish: int = 100_000) -> DataFrame:
    """(node, class, recurrent): strongly connected components, named by their smallest node, and whether no edge leaves them.

    Each round hashes the nodes anew and finds, forward and backward, the node of least hash that each one reaches and is reached by. Nodes for which both
    are the same node are in its class; edges between nodes that differ in either join no class and go, so what is left falls apart and
    rounds grow with the logarithm of the nodes. Nodes without an edge in or out are classes of their own at once. When at most `finish`
    edges are left, the driver ends the search.
    """
    edges = cut(edges.filter("w > 0").select("i", "j").distinct())
    left = cut(edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct())
    edges = edges.filter("i <> j")
    placed, rest = left.select("node", F.col("node").alias("root")).limit(0), cut(edges)
    for seed in range(max_rounds):
        if rest.limit(finish + 1).count() <= finish:
            roots = strong_components([tuple(r) for r in rest.collect()])
            kind = left.schema["node"].dataType.simpleString()
            found = left.sparkSession.createDataFrame(list(roots.items()), f"node {kind}, root {kind}")
            placed = placed.union(left.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
            break
        inner = stored(rest.select(F.col("i").alias("node")).distinct().join(rest.select(F.col("j").alias("node")).distinct(), "node", "left_semi"))
        placed = placed.union(stored(left.join(inner, "node", "left_anti").select("node", F.col("node").alias("root"))))
        if inner.isEmpty():
            break
        rest = stored(rest.join(inner.select(F.col("node").alias("i")), "i", "left_semi").join(inner.select(F.col("node").alias("j")), "j", "left_semi"))
        both = stored(_meeting(rest, inner, seed, max_rounds))
        placed = placed.union(both.filter("f = b").select("node", F.col("f").alias("root")))
        left = stored(both.filter("f <> b").select("node", F.xxhash64("f", "b").alias("key")))  # nodes of different keys are in different classes
        ends = lambda at: left.select(F.col("node").alias(at), F.col("key").alias(f"key_{at}"))  # noqa: B023, E731
        rest = stored(rest.join(ends("i"), "i").join(ends("j"), "j").filter("key_i = key_j").select("i", "j"))
        left = left.select("node")
    else:
        raise RuntimeError("classes did not settle")
    placed = cut(placed)
    classes = cut(placed.join(placed.groupBy("root").agg(F.min("node").alias("class")), "root").select("node", "class"))
    leaving = edges.join(classes.select(F.col("node").alias("i"), F.col("class").alias("ci")), "i").join(classes.select(F.col("node").alias("j"), F.col("class").alias("cj")), "j").filter("ci <> cj").select(F.col("ci").alias("class")).distinct()
    return classes.join(leaving.withColumn("leaves", F.lit(True)), "class", "left").select("node", "class", F.col("leaves").isNull().alias("recurrent"))


def irreducible(edges: DataFrame) -> bool:
    """Whether all nodes are in one communicating class."""
    return communicating_classes(edges).select("class").distinct().limit(2).count() == 1


def walk_cells(cells: DataFrame, spec, kind: str = "start") -> DataFrame:
    """(obs) of cells (obs, ...) by {column: values} (or, for a number column, {column: (low, high)}, both included), one id, a list of ids, or a condition; none is an error."""
    if isinstance(spec, dict):
        if len(spec) != 1:
            raise ValueError("one column is needed")
        ((column, values),) = spec.items()
        if column not in cells.columns:
            raise KeyError(f"no column {column}")
        if cells.schema[column].dataType.typeName() == "string":
            found = cells.filter(F.col(column).isin(values if isinstance(values, (list, tuple, set)) else [values]))
        else:
            if len(values) != 2:
                raise ValueError("a range has two ends")
            found = cells.filter(F.col(column).between(*sorted(values)))
    elif isinstance(spec, Column):
        found = cells.filter(spec)
    else:
        ids = spec if isinstance(spec, (list, tuple, set)) else [spec]
        found = cells.filter(F.col("obs").isin(list(ids)))
    found = found.select("obs").distinct()
    if found.isEmpty():
        raise ValueError(f"no {kind} cells")
    return found


def walk_length(length: int | float, cells: int) -> int:
    """Steps of a walk: a number, or a share of the cells, rounded up; more than 1."""
    steps = math.ceil(length * cells) if isinstance(length, float) else length
    if steps <= 1:
        raise ValueError(f"a walk needs more than one step, not {steps}")
    return steps


def walk_starts(cells: DataFrame, walks: int, seed: int = 0) -> DataFrame:
    """(walk, obs): each walk's start among cells (obs), drawn by a hash of seed and walk from their places by id."""
    placed = cut(sorted_places(cells.select("obs", F.lit(0).alias("one")), "one", ["obs"], "r").select("obs", "r"))
    n = placed.count()
    drawn = cells.sparkSession.range(walks).select(F.col("id").alias("walk"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)) + 1).alias("r"))
    return drawn.join(placed, "r").select("walk", "obs")


def random_walks(edges: DataFrame, starts: DataFrame, steps: int, seed: int = 0, stops: DataFrame | None = None, hits: int = 0) -> DataFrame:
    """(walk, step, obs) of walks from starts (walk, obs), all advanced together, one join a step.

    A walk's step draws from a hash of seed, walk and step, so the result is the same on any cluster. Where stops (obs) are
    given, a walk ends after it has been in them `hits` + 1 times in a row.
    """
    group = "PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND"
    ladder = cut(edges.filter("w > 0").select("i", "j", F.expr(f"sum(w) OVER ({group} CURRENT ROW)").alias("high"), F.expr(f"coalesce(sum(w) OVER ({group} 1 PRECEDING), 0D)").alias("low"), F.expr("sum(w) OVER (PARTITION BY i)").alias("total")))
    at = cut(starts.select("walk", F.lit(0).alias("step"), "obs", F.lit(0).alias("run")))
    all_steps = at.select("walk", "step", "obs")
    end = stops.select(F.col("obs").alias("stop")).distinct() if stops is not None else None
    for k in range(1, steps + 1):
        draw = F.pmod(F.xxhash64(F.lit(seed), "walk", F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        here = at.withColumn("u", draw)
        moved = here.join(ladder, here["obs"] == ladder["i"]).filter("u * total >= low AND u * total < high").select("walk", F.lit(k).alias("step"), F.col("j").alias("obs"), "run")
        if end is not None:
            moved = moved.join(end, F.col("obs") == F.col("stop"), "left").select("walk", "step", "obs", F.when(F.col("stop").isNotNull(), F.col("run") + 1).otherwise(0).alias("run"))
        moved = cut(moved)
        all_steps = all_steps.union(moved.select("walk", "step", "obs"))
        at = moved.filter(F.col("run") <= hits) if end is not None else moved
    return all_steps
