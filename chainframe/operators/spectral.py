"""Terminal states from single eigenvectors: cells at the ends of the leading left eigenvectors, clustered by the right ones."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import ratio
from chainframe.lineage import cut, release
from chainframe.linalg.arnoldi import eigenpairs, invariant, times
from chainframe.operators.communities import communities
from chainframe.operators.matrix import transpose
from chainframe.operators.neighbors import knn, neighbour_votes


def spectrum(edges: DataFrame, k: int, left: bool = False, steps: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """The k leading eigenvalues (largest real part first; one more if k would split a conjugate pair), (i, re0, im0, re1, ...), the right or left unit
    eigenvectors, and their residuals |T v - lambda v|.

    A vector's entry of largest size is real and positive, so the vectors of a pair are conjugates. It raises after `steps` restarts.
    """
    basis, r, gap = invariant(transpose(edges) if left else edges, k, tol, steps)
    values, inner = eigenpairs(r)
    size = len(values)
    names = [f"{part}{n}" for n in range(size) for part in ("re", "im")]
    both = np.stack([inner.real, inner.imag], 2).reshape(size, 2 * size)
    rows = cut(times(basis, [f"x{n}" for n in range(size)], both, names))
    length = lambda n: F.round(F.hypot(f"re{n}", f"im{n}"), 12)
    tops = rows.agg(*[F.max_by(F.struct(F.col(f"re{n}").alias("re"), F.col(f"im{n}").alias("im")), F.struct(length(n), -F.hash("i"))).alias(f"t{n}") for n in range(size)]).first()
    turned = []
    for n in range(size):
        top = complex(tops[f"t{n}"]["re"], tops[f"t{n}"]["im"])
        c, s = (np.conj(top) / abs(top)).real, (np.conj(top) / abs(top)).imag
        turned += [(F.col(f"re{n}") * float(c) - F.col(f"im{n}") * float(s)).alias(f"re{n}"), (F.col(f"re{n}") * float(s) + F.col(f"im{n}") * float(c)).alias(f"im{n}")]
    # at most: the subspace's own residual, and rounding inside it
    return values, rows.select("i", *turned), np.linalg.norm(r @ inner - inner * values, axis=0) + gap


def eigenvectors(edges: DataFrame, k: int, left: bool = False, steps: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, DataFrame]:
    """The k leading eigenvalues and (i, v0, v1, ...), a real basis of the right or left eigenvectors: of a conjugate pair the real part, then the imaginary part."""
    values, rows, _ = spectrum(edges, k, left, steps, tol)
    part = ["re" if v.imag >= 0 else "im" for v in values]
    return values[:k], rows.select("i", *[F.col(f"{part[n]}{n}").alias(f"v{n}") for n in range(min(k, len(values)))])


def outer_cells(vectors: DataFrame, names: list[str], percentile: float) -> DataFrame:
    """(i) of rows of which some entry's size reaches that percentile of its column."""
    if not 0 <= percentile <= 100:
        raise ValueError("percentile is from 0 to 100")
    cuts = vectors.agg(*[F.expr(f"percentile(abs({n}), {percentile / 100})").alias(f"_{n}") for n in names])
    keep = F.lit(False)
    for n in names:
        keep = keep | (F.abs(n) >= F.col(f"_{n}"))
    return vectors.crossJoin(F.broadcast(cuts)).filter(keep).select("i")


def terminal_probability(vectors: DataFrame, names: list[str], values: list[float]) -> DataFrame:
    """(i, p): sizes of left eigenvector entries scaled to [0, 1] by column, over the eigenvalue, summed, and divided by the largest sum."""
    ends = vectors.agg(*[f(F.abs(n)).alias(f"_{w}_{n}") for n in names for w, f in (("low", F.min), ("high", F.max))])
    total = F.lit(0.0)
    for n, value in zip(names, values):
        total = total + ratio(F.abs(n) - F.col(f"_low_{n}"), F.col(f"_high_{n}") - F.col(f"_low_{n}")) / float(np.real(value))
    rows = vectors.crossJoin(F.broadcast(ends)).select("i", total.alias("c"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("c").alias("top")))).select("i", ratio(F.col("c"), F.col("top")).alias("p"))


def propagated(edges: DataFrame, rounds: int = 300) -> DataFrame:
    """(i, cluster): communities of a graph by label propagation, numbered from 0 by size; each cell takes the label of most weight among its neighbours and itself, ties to the smallest.

    A round is a join and two sums; from the fourth on only half of the cells, by a hash of round and cell, take their new label, since cells that all change at once can
    flip for ever. It ends when no label would change, or raises.
    """
    edges = cut(edges.select("i", "j", "w"))
    loops = edges.groupBy("i").agg(F.max("w").alias("w")).select("i", F.col("i").alias("j"), "w")
    both = cut(edges.unionByName(loops))
    labels = cut(loops.select("i", F.col("i").alias("label")))
    for k in range(rounds):
        votes = both.join(labels.withColumnRenamed("i", "j"), "j").groupBy("i", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("i").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("next"))
        new = cut(best.join(labels, "i"))
        same = new.filter("next <> label").isEmpty()
        release(labels)
        turn = F.lit(True) if k < 3 else F.xxhash64(F.lit(k), "i").bitwiseAND(F.lit(1)) == 1
        labels = cut(new.select("i", F.when(turn, F.col("next")).otherwise(F.col("label")).alias("label")))
        release(new)
        if same:
            break
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    numbered = sizes.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).alias("cluster"))  # a row for each community
    return labels.join(numbered, "label").select("i", "cluster")


def clusters(points: DataFrame, columns: list[str], method: str = "kmeans", k: int | None = None, neighbours: int = 20, seed: int = 0, resolution: float = 1.0) -> DataFrame:
    """(i, cluster) of a wide table: k-means, or communities of the k-nearest-neighbour graph, by modularity ("communities") or by label propagation."""
    if method == "kmeans":
        if not k:
            raise ValueError("k-means needs a number of clusters")
        rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(points.select("i", *columns))
        return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(rows).transform(rows).select("i", "cluster")
    if method not in ("propagation", "communities"):
        raise ValueError("method is kmeans, communities or propagation")
    means = points.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    rows = points.crossJoin(F.broadcast(means)).select("i", F.array(*[F.col(c) - F.col(f"_{c}") for c in columns]).alias("x"))
    graph = knn(rows, neighbours).select("i", "j", "w")
    return communities(graph, resolution) if method == "communities" else propagated(graph)


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean over their population deviation; constant ones are 0."""
    stats = rows.agg(*[f(c).alias(f"_{w}_{c}") for c in columns for w, f in (("m", F.avg), ("s", F.stddev_pop))])
    return rows.crossJoin(F.broadcast(stats)).withColumns({c: ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).select(rows.columns)


def terminal_states(edges: DataFrame, k: int, use: list[int] | None = None, percentile: float | None = 98, method: str = "kmeans", n_clusters: int | None = None, graph: DataFrame | None = None, least_votes: int = 0, scale: bool = False, steps: int = 200) -> tuple[DataFrame, DataFrame]:
    """((obs, state), (i, p)): states "0", "1", ... from the eigenvectors numbered in `use` (the first k), and every cell's terminal probability.

    Cells that reach the percentile in some left eigenvector are clustered by the right ones, by default into as many clusters as eigenvectors (one more
    without a percentile); with `least_votes`, cells need so many neighbours of their own cluster in `graph`.
    """
    use = list(range(k)) if use is None else use
    names = [f"v{n}" for n in use]
    values, left = eigenvectors(edges, k, True, steps)
    _, right = eigenvectors(edges, k, False, steps)
    left, right = cut(left), cut(right)
    rows = right.select("i", *names)
    if percentile is not None:
        rows = rows.join(outer_cells(left, names, percentile), "i", "left_semi")
    rows = cut(standardized(rows, names) if scale else rows)
    wanted = n_clusters or len(use) + (percentile is None)
    if rows.limit(wanted).count() < wanted:
        raise ValueError(f"fewer than {wanted} cells are left; lower the percentile")
    found = clusters(rows, names, method, wanted).select("i", F.col("cluster").cast("string").alias("label"))
    if least_votes:
        if graph is None:
            raise ValueError("votes need a graph")
        found = neighbour_votes(graph, cut(found), least_votes)
    return found.select(F.col("i").alias("obs"), F.col("label").alias("state")), terminal_probability(left, names, [values[n] for n in use])
