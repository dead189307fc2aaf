"""Kernels: from neighbour graphs and annotations to transition matrices, and expressions of kernels."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import centred, dot, minus, norm, ratio, sum_vectors
from chainframe.lineage import cut
from chainframe.operators import matrix

# ---- transition matrices


def connectivity(edges: DataFrame, density: bool = True) -> DataFrame:
    """The row-normalized graph, first divided by the column sums of both ends if `density`."""
    return matrix.row_normalize(matrix.density_normalize(edges) if density else edges.select("i", "j", "w"))


def similarity(v: Column, d: Column, scheme: str | Callable[[Column, Column], Column]) -> Column:
    """Of a velocity and a displacement: dot product, cosine or correlation (0 where a length is 0), or a function of both columns."""
    if callable(scheme):
        return scheme(v, d)
    if scheme == "dot":
        return dot(v, d)
    if scheme not in ("cosine", "correlation"):
        raise ValueError("scheme is dot, cosine, correlation or a function of two columns")
    if scheme == "correlation":
        v, d = centred(v), centred(d)
    return ratio(dot(v, d), norm(v) * norm(d))


def _pairs(edges: DataFrame, cells: DataFrame, backward: str | None = None) -> DataFrame:
    """Edges with the velocity `a` and the displacement `d` to compare, and the cell's other columns.

    Backward "transpose" compares the neighbour's velocity with the way from it; "negate" turns velocities round.
    """
    if backward not in (None, "transpose", "negate"):
        raise ValueError("backward is transpose or negate")
    near = cells.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("v").alias("vj"))
    both = edges.select("i", "j").join(cells, "i").join(near, "j")
    d, v = minus(F.col("xj"), F.col("x")), F.col("v")
    if backward == "transpose":
        v, d = F.col("vj"), F.transform(d, lambda y: -y)
    elif backward == "negate":
        v = F.transform(v, lambda y: -y)
    return both.withColumn("a", v).withColumn("d", d).drop("x", "v", "xj", "vj")


def velocity_scores(edges: DataFrame, cells: DataFrame, scheme: str | Callable = "correlation", backward: str | None = None) -> DataFrame:
    """(i, j, score) for cells (i, x, v); for backward see `_pairs`."""
    return _pairs(edges, cells, backward).select("i", "j", similarity(F.col("a"), F.col("d"), scheme).alias("score"))


def softmax_scale(scores: DataFrame) -> DataFrame:
    """One row: 1 / the median of non-zero absolute scores, exact."""
    return scores.filter("score <> 0").agg((1 / F.expr("percentile(abs(score), 0.5)")).alias("scale"))


def velocity(edges: DataFrame, cells: DataFrame, scheme: str | Callable = "correlation", scale: float | None = None, backward: str | None = None) -> DataFrame:
    """Softmax over each row of scale * score; without a scale, `softmax_scale` of all scores, which are then computed once and kept. A cell without velocity moves evenly."""
    scores = velocity_scores(edges, cells, scheme, backward)
    if scale is None:
        scores = cut(scores)
        scores = scores.crossJoin(F.broadcast(softmax_scale(scores)))  # one row
    else:
        scores = scores.withColumn("scale", F.lit(float(scale)))
    return scores.select("i", "j", matrix.softmax(F.col("score") * F.col("scale")).alias("w")).filter("w > 0")


def velocity_monte_carlo(edges: DataFrame, cells: DataFrame, scheme: str | Callable = "correlation", scale: float = 1.0, samples: int = 100, seed: int = 0) -> DataFrame:
    """The mean of softmax rows over velocities drawn around those of cells (i, x, v, var), with `var` entries as standard deviations.

    Draws are normal numbers from a hash of seed, cell, sample and entry, so the result is the same on any cluster.
    """
    def unit(k: Column, which: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(which), "i", "sample", k), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    drawn = F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda k: F.sqrt(-2 * F.ln(unit(k, 1))) * F.cos(2 * math.pi * unit(k, 2)))
    each = cells.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("a", F.col("v"))
    moved = F.zip_with(F.col("v"), F.zip_with(drawn, F.col("var"), lambda z, s: z * s), lambda m, e: m + e)
    each = each.withColumn("a", moved).select("i", "sample", "x", "a")
    near = cells.select(F.col("i").alias("j"), F.col("x").alias("xj"))
    rows = edges.select("i", "j").join(each, "i").join(near, "j").select("i", "j", "sample", similarity(F.col("a"), minus(F.col("xj"), F.col("x")), scheme).alias("score"))
    probabilities = rows.select("i", "j", matrix.softmax(F.col("score") * float(scale), ["i", "sample"]).alias("w"))
    return probabilities.groupBy("i", "j").agg((F.sum("w") / float(samples)).alias("w")).filter("w > 0")


def velocity_stochastic(edges: DataFrame, cells: DataFrame, dims: int, scheme: str = "correlation", scale: float = 1.0) -> DataFrame:
    """Softmax rows to second order in the velocity's variance, for cells (i, x, v, var) of `dims` entries.

    w = p + 1/2 sum over entries of p'' var, cut to [0, 1] and normalized again; rows of zeros, and cells without velocity, are even. With l the scaled
    score, p'' = p ((l' - m)^2 + l'' - mean(l'' + l'^2) + m^2), where means go over the row by p and m = mean(l').
    """
    rows = _pairs(edges, cells)
    a, d = F.col("a"), F.col("d")
    if scheme == "dot":
        rows = rows.withColumn("score", dot(a, d) * scale).withColumn("l1", F.transform("d", lambda x: x * scale)).withColumn("l2", F.transform("d", lambda x: F.lit(0.0)))
    elif scheme in ("cosine", "correlation"):
        whole = 1.0 if scheme == "cosine" else 1 - 1 / dims
        if scheme == "correlation":
            rows = rows.withColumn("a", centred(a)).withColumn("d", centred(d))
        rows = rows.withColumn("d", F.transform("d", lambda x: ratio(x, norm(F.col("d"))))).withColumn("r", norm(a)).withColumn("s", dot(a, d))
        r, s = F.col("r"), F.col("s")
        rows = rows.withColumn("score", ratio(s, r) * scale)
        rows = rows.withColumn("l1", F.zip_with("a", "d", lambda v, u: scale * (ratio(u, r) - ratio(s * v, r * r * r))))
        rows = rows.withColumn("l2", F.zip_with("a", "d", lambda v, u: scale * (ratio(-2 * u * v - s * whole, r * r * r) + ratio(3 * s * v * v, r * r * r * r * r))))
    else:
        raise ValueError("scheme is dot, cosine or correlation")
    rows = rows.withColumn("still", norm(a) == 0).withColumn("p", matrix.softmax(F.col("score"))).withColumn("q", F.zip_with("l1", "l2", lambda x, y: y + x * x))
    rows = cut(rows.select("i", "j", "still", "p", "l1", "l2", "q", "var"))
    sums = rows.groupBy("i").agg(sum_vectors("l1", dims, F.col("p")).alias("m"), sum_vectors("q", dims, F.col("p")).alias("mq"))
    both = rows.join(sums, "i")
    ahead = F.zip_with(F.zip_with("l1", "m", lambda x, m: (x - m) * (x - m) + m * m), F.zip_with("l2", "mq", lambda y, q: y - q), lambda x, y: x + y)
    second = F.col("p") * dot(ahead, F.col("var")) / 2
    raw = F.greatest(F.least(F.col("p") + second, F.lit(1.0)), F.lit(0.0))
    both = both.select("i", "j", "still", F.when(F.isnan(raw), 0.0).otherwise(raw).alias("w"))
    even = F.col("still") | (F.sum("w").over(Window.partitionBy("i")) == 0)
    return matrix.row_normalize(both.select("i", "j", F.when(even, 1.0).otherwise(F.col("w")).alias("w"))).filter("w > 0")


def times_of(cells: DataFrame, column: str, backward: bool = False) -> DataFrame:
    """(i, t) from a column of the cells, max - t if backward; a missing column or value is an error."""
    if column not in cells.columns:
        raise KeyError(f"no column {column}")
    times = cells.select("i", F.col(column).cast("double").alias("t"))
    if not times.filter(F.col("t").isNull() | F.isnan("t")).isEmpty():
        raise ValueError(f"{column} has missing values")
    return times.crossJoin(F.broadcast(times.agg(F.max("t").alias("top")))).select("i", (F.col("top") - F.col("t")).alias("t")) if backward else times


def pseudotime(edges: DataFrame, times: DataFrame, scheme: str | Callable = "hard", keep: float = 0.3, b: float = 10.0, nu: float = 0.5) -> DataFrame:
    """The graph biased towards later times (i, t) and row-normalized.

    Hard: edges to times not before the cell's stay, and of the others the strongest min(30, floor(degree * keep)) of the row.
    Soft: edges to earlier times are multiplied by 2 / (1 + e^(b dt))^(1 / nu). A function takes a cell's time and the
    arrays of its neighbours' times and weights and gives new weights; a group is one cell's neighbours.
    """
    both = edges.select("i", "j", "w").join(times, "i").join(times.select(F.col("i").alias("j"), F.col("t").alias("tj")), "j")
    if scheme == "hard":
        row = Window.partitionBy("i")
        rank = F.row_number().over(row.orderBy(F.desc("w"), F.desc("j")))
        spared = F.least(F.lit(30), F.floor(F.count("*").over(row) * keep))
        both = both.withColumn("rank", rank).withColumn("spared", spared).filter((F.col("t") <= F.col("tj")) | (F.col("rank") <= F.col("spared")))
    elif scheme == "soft":
        late = F.col("t") - F.col("tj")
        both = both.withColumn("w", F.col("w") * F.when(late > 0, 2 / F.pow(1 + F.exp(b * late), F.lit(1 / nu))).otherwise(1.0))
    elif callable(scheme):

        def biased(rows: pd.DataFrame) -> pd.DataFrame:
            new = np.asarray(scheme(float(rows["t"].iloc[0]), rows["tj"].to_numpy(float), rows["w"].to_numpy(float)), float)
            if new.shape != (len(rows),):
                raise ValueError("a scheme gives one weight for each neighbour")
            return rows[["i", "j"]].assign(w=new)

        kind = edges.schema["i"].dataType.simpleString()
        both = both.groupBy("i").applyInPandas(biased, f"i {kind}, j {kind}, w double").filter("w <> 0")
    else:
        raise ValueError("scheme is hard, soft or a function")
    return matrix.row_normalize(both.select("i", "j", "w"))


def sparsified(couplings: DataFrame, threshold: str | float = "auto") -> DataFrame:
    """Couplings (src, tgt, i, j, w) without their small entries, rows normalized.

    "auto": below the least row maximum of all; "auto_local": of the same pair of levels; a number: below that percentile of
    the pair's entries.
    """
    top = couplings.groupBy("src", "tgt", "i").agg(F.max("w").alias("top"))
    if threshold == "auto":
        held = couplings.crossJoin(F.broadcast(top.agg(F.min("top").alias("least"))))
    elif threshold == "auto_local":
        held = couplings.join(F.broadcast(top.groupBy("src", "tgt").agg(F.min("top").alias("least"))), ["src", "tgt"])
    else:
        cut = couplings.groupBy("src", "tgt").agg(F.expr(f"percentile(w, {float(threshold) / 100})").alias("least"))
        held = couplings.join(F.broadcast(cut), ["src", "tgt"])
    return matrix.row_normalize(held.filter("w >= least").select("src", "tgt", "i", "j", "w"))


def couplings_by(compute: Callable[[object, object], DataFrame], pairs: list[tuple]) -> DataFrame:
    """(src, tgt, i, j, w) of the tables (i, j, w) that a function gives for each pair of levels, a short list."""
    out = None
    for src, tgt in pairs:
        own = compute(src, tgt).select(F.lit(src).alias("src"), F.lit(tgt).alias("tgt"), "i", "j", "w")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no pairs of levels")
    return out


def complete_couplings(couplings: DataFrame, cells: DataFrame, fill: bool = True) -> DataFrame:
    """Couplings whose cells are those of their levels (i, t), or an error; cells of a source level without entries move evenly to all of the target's, if `fill`."""
    levels = cut(couplings.select("src", "tgt").distinct())
    for end, level in (("i", "src"), ("j", "tgt")):
        wrong = couplings.select(level, F.col(end).alias("i")).distinct().join(cells, "i", "left").filter(~F.col("t").eqNullSafe(F.col(level))).limit(1).collect()
        if wrong:
            raise IndexError(f"cell {wrong[0]['i']} isn't of level {wrong[0][level]}")
    whole = couplings.filter("w <> 0")
    empty = cells.join(F.broadcast(levels), F.col("t") == F.col("src")).select("src", "tgt", "i").join(whole.select("src", "tgt", "i").distinct(), ["src", "tgt", "i"], "left_anti")
    if not fill:
        return whole
    ends = cells.select(F.col("i").alias("j"), F.col("t").alias("tgt"))
    sizes = ends.groupBy("tgt").agg(F.count("*").alias("n"))
    even = empty.join(F.broadcast(sizes), "tgt").join(ends, "tgt").select("src", "tgt", "i", "j", (1 / F.col("n")).alias("w"))
    return whole.unionByName(even)


def real_time(couplings: DataFrame, last: DataFrame, threshold: str | float | None = "auto", self_weight: float = 1.0, self_transitions: str | list = "diagonal", graph: DataFrame | None = None, conn_weight: float = 0.2) -> DataFrame:
    """One chain from couplings of successive levels.

    Cells of the last level (i) keep to themselves ("diagonal"), move evenly among each other ("uniform", the square of their number of entries) or along the
    density-normalized graph between them ("connectivities"). A list of source levels gives their cells conn_weight of the graph between them and the
    rest of the coupling, and those of the last level the graph. Levels are cells' (i) of the couplings; the graph's edges between levels count for nothing.
    """
    blocks = matrix.row_normalize(couplings) if threshold is None else sparsified(couplings, threshold)

    def within(cells: DataFrame) -> DataFrame:
        if graph is None:
            raise ValueError("a graph is needed")
        own = graph.join(cells.select("i", F.col("level")), "i").join(cells.select(F.col("i").alias("j"), F.col("level").alias("other")), "j").filter("level = other")
        return connectivity(own.select("i", "j", "w"))

    ends = last.select("i").distinct().withColumn("level", F.lit("last"))
    if self_transitions == "diagonal":
        own = last.select("i", F.col("i").alias("j"), F.lit(float(self_weight)).alias("w"))
    elif self_transitions == "uniform":
        n = F.broadcast(ends.agg(F.count("*").alias("n")))
        own = ends.select("i").crossJoin(ends.select(F.col("i").alias("j"))).crossJoin(n).select("i", "j", (1 / F.col("n")).alias("w"))
    elif self_transitions == "connectivities":
        own = within(ends)
    elif isinstance(self_transitions, list):
        named = F.col("src").isin(self_transitions)
        inner = within(blocks.filter(named).select("i", F.col("src").cast("string").alias("level")).distinct())
        own = within(ends).unionByName(inner.withColumn("w", F.col("w") * conn_weight))
        blocks = blocks.withColumn("w", F.when(named, F.col("w") * (1 - conn_weight)).otherwise(F.col("w")))
    else:
        raise ValueError("self_transitions is diagonal, uniform, connectivities or a list of levels")
    return blocks.select("i", "j", "w").unionByName(own)


# ---- expressions


@dataclass(frozen=True)
class Kernel:
    """A kernel or an expression of kernels: `edges` evaluates it. Kernels add, multiply and take positive factors."""

    compute: DataFrame | None = None
    backward: bool | None = None
    op: str = "base"
    parts: tuple = field(default=())

    def edges(self) -> DataFrame:
        if self.op == "base":
            if self.compute is None:
                raise ValueError("a kernel has no transition matrix yet")
            return self.compute
        if self.op in ("sum", "scaled"):
            total = sum(c for c, _ in self.parts)
            return matrix.weighted_sum([(c / total, k.edges()) for c, k in self.parts])
        (_, first), *rest = self.parts
        out = first.edges()
        for _, k in rest:
            out = matrix.hadamard(out, k.edges())
        return matrix.row_normalize(out)

    def weights(self) -> list[float]:
        """Of the parts of a sum, as used: they add up to 1."""
        total = sum(c for c, _ in self.parts)
        return [c / total for c, _ in self.parts]

    def kernels(self) -> list[Kernel]:
        """The base kernels of the expression, each once, in order."""
        found = [self] if self.op == "base" else [k for _, part in self.parts for k in part.kernels()]
        return list({id(k.compute) if k.compute is not None else id(k): k for k in found}.values())

    def _with(self, other: Kernel, op: str) -> Kernel:
        ways = {k.backward for k in (self, other)} - {None}
        if len(ways) > 1:
            raise ValueError("forward and backward kernels don't combine")
        flat = []
        for k in (self, other):
            flat += k.parts if k.op == op else [(1.0, k)] if k.op != "scaled" else k.parts
        return Kernel(None, ways.pop() if ways else None, op, tuple(flat))

    def __add__(self, other: Kernel) -> Kernel:
        return self._with(other, "sum")

    def __mul__(self, other) -> Kernel:
        if isinstance(other, Kernel):
            return self._with(other, "product")
        if not other > 0:
            raise ValueError("a factor must be positive")
        factor, inner = (self.parts[0][0], self.parts[0][1]) if self.op == "scaled" else (1.0, self)
        return Kernel(None, self.backward, "scaled", ((factor * float(other), inner),))

    __rmul__ = __mul__

    def __invert__(self) -> Kernel:
        """The other direction, to be computed anew; kernels without direction stay."""
        if self.op != "base":
            return Kernel(None, None if self.backward is None else not self.backward, self.op, tuple((c, ~k) for c, k in self.parts))
        return self if self.backward is None else Kernel(None, not self.backward)
