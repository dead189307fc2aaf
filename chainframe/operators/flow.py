"""Flows between groups over time, alignment to time grids, and per-row geometry of transition matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import centred, dot, minus, norm, ratio, scaled, sum_vectors
from chainframe.lineage import cut


def flow(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(t_from, t_to, src, dst, w): the matrix summed by time pair and clusters of both ends, each source's row normalized; cells are (i, cluster, t)."""
    here = cells.select("i", F.col("cluster").alias("src"), F.col("t").alias("t_from"))
    there = cells.select(F.col("i").alias("j"), F.col("cluster").alias("dst"), F.col("t").alias("t_to"))
    sums = edges.join(here, "i").join(there, "j").groupBy("t_from", "t_to", "src", "dst").agg(F.sum("w").alias("w"))
    row = Window.partitionBy("t_from", "t_to", "src")
    return sums.withColumn("w", ratio(F.col("w"), F.sum("w").over(row)))


def without_small_flows(flows: DataFrame, cluster, min_flow: float) -> DataFrame:
    """Flows from a cluster to those that get more than min_flow from it at some time."""
    own = flows.filter(F.col("src") == cluster)
    return own.join(own.groupBy("dst").agg(F.max("w").alias("top")).filter(F.col("top") > min_flow), "dst", "left_semi")


def contingency(cells: DataFrame) -> DataFrame:
    """(t, cluster, share) of each cluster among the cells of a time."""
    counts = cells.groupBy("t", "cluster").agg(F.count("*").alias("c"))
    return counts.select("t", "cluster", (F.col("c") / F.sum("c").over(Window.partitionBy("t"))).alias("share"))


def composition(cells: DataFrame, key: str) -> DataFrame:
    """(key, n, share) of each value."""
    counts = cells.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def nearest_in_time(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(g, t, v) for each grid time g: the value v at the nearest time t of points (t, v); of two as near, the later.

    An as-of join: both tables in one window ordered by time, cut into ranges of time that are
    joined by the last point of the ranges before and the first of those after.
    """
    events = points.select(F.col("t").alias("at"), F.struct("t", "v").alias("p"), F.lit(None).cast(grid.schema["g"].dataType).alias("g"))
    asks = grid.select(F.col("g").alias("at"), F.lit(None).cast(events.schema["p"].dataType).alias("p"), "g")
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = events.union(asks).repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id())
    both = cut(both)  # partition numbers must not change
    ends = both.groupBy("part").agg(F.max("p").alias("last"), F.min("p").alias("first"))  # a row for each partition
    order = Window.orderBy("part")
    carried = ends.select("part", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    # running values from both ends: a window towards the far end would be computed anew for each row
    up, down = (Window.partitionBy("part").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("at"), F.desc("at")))
    rows = both.withColumn("lo", F.max("p").over(up)).withColumn("hi", F.min("p").over(down))
    rows = rows.filter("g IS NOT NULL").join(F.broadcast(carried), "part")
    lo, hi = F.coalesce("lo", "before"), F.coalesce("hi", "after")
    best = F.when(lo.isNull() | (hi["t"] - F.col("g") <= F.col("g") - lo["t"]), hi).otherwise(lo)
    return rows.select("g", best.alias("b")).select("g", "b.t", "b.v")


def moving_average(table: DataFrame, by: str, order: str, value: str, width: int) -> DataFrame:
    """Adds `smooth`: the mean of the `width` values around each row, the end values standing for what lies beyond."""
    left, right = width // 2, width - 1 - width // 2
    w = Window.partitionBy(by).orderBy(order)
    n, c = F.row_number().over(w), F.count("*").over(Window.partitionBy(by))
    inside = F.sum(value).over(w.rowsBetween(-left, right))
    before, after = F.greatest(F.lit(left) - (n - 1), F.lit(0)), F.greatest(F.lit(right) - (c - n), F.lit(0))
    whole = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    padded = inside + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return table.withColumn("smooth", padded / width)


def peaks(trends: DataFrame) -> DataFrame:
    """(var, peak, nth) of trends (var, t, y): the time of each largest value, the first of equals, and its order."""
    best = trends.groupBy("var").agg(F.max_by("t", F.struct("y", -F.col("t"))).alias("peak"))
    return best.withColumn("nth", F.row_number().over(Window.orderBy("peak", "var")))  # one row for each feature


def vector_field(edges: DataFrame, cells: DataFrame, dims: int) -> DataFrame:
    """(i, v): where the matrix moves each cell, T X - X, of cells (i, x)."""
    near = cells.select(F.col("i").alias("j"), F.col("x").alias("xj"))
    moved = edges.join(near, "j").groupBy("i").agg(sum_vectors("xj", dims, F.col("w")).alias("m"))
    return moved.join(cells, "i").select("i", minus(F.col("m"), F.col("x")).alias("v"))


def projection(edges: DataFrame, graph: DataFrame, cells: DataFrame, dims: int) -> DataFrame:
    """(i, v): the matrix as arrows: over graph neighbours, the sum of w times unit displacements less their mean."""
    near = cells.select(F.col("i").alias("j"), F.col("x").alias("xj"))
    d = minus(F.col("xj"), F.col("x"))
    unit = F.when(norm(d) > 0, scaled(d, F.try_divide(F.lit(1.0), norm(d)))).otherwise(F.transform(d, lambda v: F.lit(0.0)))
    rows = graph.select("i", "j").join(edges, ["i", "j"], "left").fillna(0.0, ["w"]).join(cells, "i").join(near, "j").select("i", "w", unit.alias("u"))
    sums = rows.groupBy("i").agg(sum_vectors("u", dims, F.col("w")).alias("a"), sum_vectors("u", dims).alias("b"), F.count("*").alias("c"))
    return sums.select("i", minus(F.col("a"), scaled(F.col("b"), 1 / F.col("c"))).alias("v"))


def cross_boundary(edges: DataFrame, graph: DataFrame, cells: DataFrame, labels: DataFrame, source, target, dims: int) -> DataFrame:
    """(i, cbc) of source cells on the boundary: the correlation of where the matrix moves them with the mean way to their target neighbours, weighted by the graph."""
    ours = labels.filter(F.col("label") == source).select("i")
    theirs = labels.filter(F.col("label") == target).select(F.col("i").alias("j"))
    links = graph.select("i", "j", "w").join(theirs, "j", "left_semi").join(ours, "i", "left_semi")
    near = cells.select(F.col("i").alias("j"), F.col("x").alias("xj"))
    ways = links.join(cells, "i").join(near, "j").select("i", "w", minus(F.col("xj"), F.col("x")).alias("d"))
    empirical = ways.groupBy("i").agg(sum_vectors("d", dims, F.col("w")).alias("e"))
    both = empirical.join(vector_field(edges, cells, dims), "i")
    a, b = centred(F.col("v")), centred(F.col("e"))
    return both.select("i", ratio(dot(a, b), norm(a) * norm(b)).alias("cbc"))


def restricted(edges: DataFrame, cells: DataFrame, clusters: list | None = None, times: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends in the named clusters and times, and these cells (i, cluster, t); at least two times are needed."""
    for column, wanted in (("cluster", clusters), ("t", times)):
        if wanted is not None:
            known = {r[0] for r in cells.filter(F.col(column).isin(wanted)).select(column).distinct().collect()}  # at most the values asked for
            if missing := [x for x in wanted if x not in known]:
                raise KeyError(f"no {column} {missing[0]}")
            cells = cells.filter(F.col(column).isin(wanted))
    if cells.select("t").distinct().limit(2).count() < 2:
        raise ValueError("at least two times are needed")
    keys = cells.select("i")
    return edges.join(keys, "i", "left_semi").join(keys.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "w"), cells


def flow_block(edges: DataFrame, cells: DataFrame, t1, t2, cluster=None) -> DataFrame:
    """(i, j, src, dst, w): entries from cells of time t1 (and one cluster) to cells of time t2."""
    here = cells.filter(F.col("t") == t1).select("i", F.col("cluster").alias("src"))
    if cluster is not None:
        here = here.filter(F.col("src") == cluster)
    there = cells.filter(F.col("t") == t2).select(F.col("i").alias("j"), F.col("cluster").alias("dst"))
    return edges.select("i", "j", "w").join(here, "i").join(there, "j").select("i", "j", "src", "dst", "w")


def flow_order(flows: DataFrame, cluster, ascending: bool = False) -> DataFrame:
    """(cluster, total, side, place): the clusters that a cluster flows to, by total flow, dealt alternately above and below it; place counts from the middle.

    A few rows, one for each cluster.
    """
    total = flows.filter((F.col("src") == cluster) & (F.col("dst") != cluster)).groupBy(F.col("dst").alias("cluster")).agg(F.sum("w").alias("total"))
    order = F.col("total").asc() if ascending else F.col("total").desc()
    nth = F.row_number().over(Window.orderBy(order, "cluster")) - 1
    return total.withColumn("n", nth).select("cluster", "total", F.when(F.col("n") % 2 == 0, "above").otherwise("below").alias("side"), F.floor(F.col("n") / 2).cast("int").alias("place"))


def _local_lines(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 3) -> np.ndarray:
    """Robust local linear smoothing: at each place the tricube-weighted line through the nearest `share` of places, with bisquare weights from the residuals in further rounds."""
    n = max(2, int(np.ceil(share * len(x))))
    if len(x) < 3:
        return y
    robust, out = np.ones(len(x)), y
    for _ in range(rounds + 1):
        out = np.empty(len(x))
        for k, at in enumerate(x):
            d = np.abs(x - at)
            near = np.argpartition(d, n - 1)[:n]
            w = (1 - np.minimum(d[near] / max(d[near].max(), 1e-300), 1) ** 3) ** 3 * robust[near]
            c = x[near] - at
            s, sx, sxx, sv, sxv = w.sum(), w @ c, w @ (c * c), w @ y[near], w @ (c * y[near])
            det = s * sxx - sx * sx
            out[k] = (sxx * sv - sx * sxv) / det if det > 1e-12 * max(s * sxx, 1e-300) else sv / s if s > 0 else y[k]
        scale = np.median(np.abs(y - out))
        if scale <= 1e-12:
            break
        robust = (1 - np.minimum(np.abs(y - out) / (6 * scale), 1) ** 2) ** 2
    return out


def smoothed_shares(shares: DataFrame, points: int = 100, share: float = 0.3) -> DataFrame:
    """(cluster, t, y): each cluster's share (t, cluster, share) over time, linear between times at `points` places a unit and then smoothed.

    A group is one cluster's times, of which there are few; a cluster absent at a time has share 0 there.
    """
    times = [float(r[0]) for r in shares.select("t").distinct().limit(1_001).collect()]
    if len(times) > 1_000:
        raise ValueError("at most 1,000 times")

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        own = pd.Series(0.0, sorted(times)).add(rows.set_index(rows["t"].astype(float))["share"], fill_value=0.0)
        grid = np.linspace(own.index[0], own.index[-1], max(2, int(round((own.index[-1] - own.index[0]) * points))))
        return pd.DataFrame({"cluster": rows["cluster"].iloc[0], "t": grid, "y": _local_lines(grid, np.interp(grid, own.index, own.to_numpy()), share)})

    kind = shares.schema["cluster"].dataType.simpleString()
    return shares.groupBy("cluster").applyInPandas(smooth, f"cluster {kind}, t double, y double")
