"""Tests, ranks and library-size factors over long tables (obs, var, x)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import ratio
from chainframe.functions.special import erfc
from chainframe.lineage import cut


def correlations(x: DataFrame, y: DataFrame, exact: bool = False) -> DataFrame:
    """(var, lineage, corr, n) of features (obs, var, x), absent entries being 0, with lineages (obs, lineage, y).

    By default covariance over n - 1 divided by population deviations, that is Pearson's times n / (n - 1), null beyond
    1 in size; `exact` gives Pearson's. Sums of products are enough, so sparse features are never filled up. Each feature
    seen in any of the cells has a row for each lineage, also where they have no cell in common.
    """
    ends = y.groupBy("lineage").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy"))
    cells = y.select("obs").distinct()
    own = x.join(cells, "obs", "left_semi").groupBy("var").agg(F.sum("x").alias("sx"), F.sum(F.col("x") ** 2).alias("sxx"))
    both = x.join(y, "obs").groupBy("var", "lineage").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    every = own.crossJoin(F.broadcast(ends))  # lineages are a short list
    rows = every.join(both, ["var", "lineage"], "left").fillna(0.0, ["sxy"])
    n = F.col("n")
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n if exact else n - 1)
    vx, vy = F.col("sxx") / n - (F.col("sx") / n) ** 2, F.col("syy") / n - (F.col("sy") / n) ** 2
    corr = F.when((vx > 1e-15) & (vy > 1e-15), F.try_divide(cov, F.sqrt(vx * vy)))
    return rows.select("var", "lineage", F.when(F.abs(corr) <= 1, corr).alias("corr"), "n")


def fisher(table: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds pval, ci_low, ci_high of corr over n cells by the z transform, and qval by Benjamini-Hochberg within each lineage."""
    z = F.atanh("corr") * F.sqrt(F.col("n") - 3)
    width = F.lit(NormalDist().inv_cdf(0.5 + level / 2)) / F.sqrt(F.col("n") - 3)
    rows = table.withColumn("pval", erfc(F.abs(z) / math.sqrt(2))).withColumn("ci_low", F.tanh(F.atanh("corr") - width)).withColumn("ci_high", F.tanh(F.atanh("corr") + width))
    return benjamini_hochberg(rows, "lineage")


def benjamini_hochberg(table: DataFrame, by: str, p: str = "pval", q: str = "qval") -> DataFrame:
    """Adds q-values within each group: the running minimum, from the largest p, of p m / rank, at most 1; null p gets null."""
    known = table.filter(F.col(p).isNotNull())
    group = Window.partitionBy(by)
    rank = F.rank().over(group.orderBy(p)) + F.count("*").over(group.orderBy(p).rangeBetween(Window.currentRow, Window.currentRow)) - 1
    scaled = known.withColumn("_r", F.col(p) * F.count("*").over(group) / rank)
    least = F.min("_r").over(group.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = scaled.withColumn(q, F.least(least, F.lit(1.0))).drop("_r")
    return out.unionByName(table.filter(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))


def sorted_places(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Adds `name`, each row's place from 1 in its group by `order`: a sort by range and counts of the ranges, so a group may fill many tasks.

    `order` must tell the rows of a group apart, else places of equal rows are any of theirs.
    """
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(tasks, by, *order).withColumn("_part", F.spark_partition_id()))  # partition numbers must not change
    sizes = dealt.groupBy(by, "_part").agg(F.count("*").alias("_c"))  # a row for each group and task at most
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    nth = F.row_number().over(Window.partitionBy("_part", by).orderBy(*order))
    return dealt.withColumn(name, nth).join(F.broadcast(before), [by, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def permutation_test(x: DataFrame, y: DataFrame, n_perms: int = 100, seed: int = 0) -> DataFrame:
    """(var, lineage, corr, pval): the share of permutations of the cells' lineage values with a correlation at least as large in size.

    Each permutation deals y anew by ranks of a hash, so it is a join on ranks and the same grouped sums; ranks come
    from a sort by range, so a permutation's cells are no single task's work.
    """
    real = correlations(x, y)
    perms = x.sparkSession.range(n_perms).select(F.col("id").alias("perm"))
    cells = y.select("obs").distinct().crossJoin(F.broadcast(perms)).withColumn("h", F.xxhash64(F.lit(seed), "perm", "obs"))
    a, b = (sorted_places(cells, "perm", order, "r").select("perm", "r", "obs") for order in (["obs"], ["h", "obs"]))
    moved = a.withColumnRenamed("obs", "to").join(b, ["perm", "r"]).join(y, "obs")
    dealt = moved.select(F.col("to").alias("obs"), F.concat_ws("|", "lineage", "perm").alias("lineage"), "y")
    drawn = correlations(x, dealt).select("var", F.regexp_replace("lineage", r"\|\d+$", "").alias("lineage"), F.col("corr").alias("drawn"))
    hits = real.join(drawn, ["var", "lineage"]).groupBy("var", "lineage").agg(F.first("corr").alias("corr"), (F.count_if(F.abs("drawn") >= F.abs("corr")) / F.lit(float(n_perms))).alias("pval"))
    return hits


def ranks(value: Column, by: Column, method: str = "average") -> Column:
    """Ranks from 1 by average, min, max, dense or ordinal."""
    group = Window.partitionBy(by).orderBy(value)
    peers = F.count("*").over(group.rangeBetween(Window.currentRow, Window.currentRow))
    if method == "min":
        return F.rank().over(group).cast("double")
    if method == "max":
        return (F.rank().over(group) + peers - 1).cast("double")
    if method == "average":
        return F.rank().over(group) + (peers - 1) / 2
    if method == "dense":
        return F.dense_rank().over(group).cast("double")
    if method == "ordinal":
        return F.row_number().over(group).cast("double")
    raise ValueError("method is average, min, max, dense or ordinal")


def expressed(x: DataFrame) -> DataFrame:
    """(obs, n): features above 0 of each cell."""
    return x.groupBy("obs").agg(F.count_if(F.col("x") > 0).alias("n"))


def cytotrace(x: DataFrame, n_vars: int = 200, aggregation: str = "mean") -> DataFrame:
    """(obs, score, pseudotime): features that go with the number of expressed features, averaged over the n_vars best and scaled to [0, 1].

    aggregation: mean, median, gmean or hmean of the chosen features, absent entries being 0; gmean and hmean of a cell with a zero are 0.
    """
    counts = expressed(x)
    corr = correlations(x, counts.select("obs", F.lit("n").alias("lineage"), F.col("n").cast("double").alias("y")))
    best = corr.filter("corr IS NOT NULL").orderBy(F.desc("corr"), "var").limit(n_vars).select("var")
    grid = counts.select("obs").crossJoin(F.broadcast(best))  # n_vars rows a cell at most
    dense = grid.join(x, ["obs", "var"], "left").fillna(0.0, ["x"])
    ways = {"mean": F.avg("x"), "median": F.expr("percentile(x, 0.5)"), "gmean": F.exp(F.avg(F.when(F.col("x") > 0, F.ln("x")).otherwise(F.lit(float("-inf"))))), "hmean": F.when(F.min("x") > 0, F.count("*") / F.sum(F.try_divide(F.lit(1.0), F.col("x")))).otherwise(0.0)}
    score = dense.groupBy("obs").agg(ways[aggregation].alias("raw"))
    ends = score.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    scaled = score.crossJoin(F.broadcast(ends)).select("obs", ratio(F.col("raw") - F.col("low"), F.col("high") - F.col("low")).alias("score"))
    return scaled.select("obs", "score", (1 - F.col("score")).alias("pseudotime"))


def library_sizes(x: DataFrame) -> DataFrame:
    return x.groupBy("obs").agg(F.sum("x").alias("size"))


def _by_geometric_mean(factors: DataFrame) -> DataFrame:
    mean = factors.agg(F.exp(F.avg(F.ln("f"))).alias("g"))
    return factors.crossJoin(F.broadcast(mean)).select("obs", (F.col("f") / F.col("g")).alias("factor"))


def _quantile(x: DataFrame, p: float) -> DataFrame:
    """(obs, size, q): the p-quantile of each cell's x / size over all features seen in any cell, zeros included."""
    sizes = library_sizes(x)
    every = F.broadcast(x.select("var").distinct().agg(F.count("*").alias("vars")))
    shares = x.filter("x <> 0").join(sizes, "obs").select("obs", "size", (F.col("x") / F.col("size")).alias("s"))
    # the zeros are only counted: order statistic k of all is k - zeros of the rest
    ranked = shares.withColumn("r", F.row_number().over(Window.partitionBy("obs").orderBy("s"))).withColumn("c", F.count("*").over(Window.partitionBy("obs"))).crossJoin(every)
    at = F.lit(p) * (F.col("vars") - 1)
    place = F.col("r") - 1 + (F.col("vars") - F.col("c"))
    low, part = F.floor(at), at - F.floor(at)
    near = F.when(place == low, 1 - part).when(place == low + 1, part).otherwise(0.0)
    return ranked.groupBy("obs", "size").agg(F.sum(F.col("s") * near).alias("q"))


def factors_uq(x: DataFrame, p: float = 0.75) -> DataFrame:
    """(obs, factor): the upper quartile of shares, over the geometric mean of all factors."""
    return _by_geometric_mean(_quantile(x, p).select("obs", F.col("q").alias("f")))


def factors_rle(x: DataFrame) -> DataFrame:
    """(obs, factor): the median ratio to the geometric mean over features present in all cells, over library size, scaled."""
    cells = F.broadcast(x.select("obs").distinct().agg(F.count("*").alias("cells")))
    full = x.filter("x > 0").groupBy("var").agg(F.count("*").alias("c"), F.exp(F.avg(F.ln("x"))).alias("g")).crossJoin(cells).filter("c = cells")
    med = x.join(full, "var").groupBy("obs").agg(F.expr("percentile(x / g, 0.5)").alias("m"))
    return _by_geometric_mean(med.join(library_sizes(x), "obs").select("obs", (F.col("m") / F.col("size")).alias("f")))


def factors_tmm(x: DataFrame, logratio_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """(obs, factor): trimmed means of log-ratios to a reference cell, weighted by precision and scaled.

    The reference is the cell whose upper quartile is nearest the mean of all. Features that are 0 in either cell take no part.
    """
    quart = _quantile(x, 0.75)
    mean = quart.agg(F.avg("q").alias("mean"))
    ref = quart.crossJoin(F.broadcast(mean)).orderBy(F.abs(F.col("q") - F.col("mean")), "obs").limit(1).select(F.col("obs").alias("ref"), F.col("size").alias("ref_size"))
    theirs = x.filter("x > 0").join(F.broadcast(ref), F.col("obs") == F.col("ref"), "inner").select("var", F.col("x").alias("rx"), "ref_size")
    both = x.filter("x > 0").join(library_sizes(x), "obs").join(theirs, "var")
    a, b = F.col("x") / F.col("size"), F.col("rx") / F.col("ref_size")
    both = both.select("obs", F.log2(a / b).alias("m"), ((F.log2(a) + F.log2(b)) / 2).alias("a"), ((F.col("size") - F.col("x")) / F.col("size") / F.col("x") + (F.col("ref_size") - F.col("rx")) / F.col("ref_size") / F.col("rx")).alias("v"))
    cell = Window.partitionBy("obs")
    both = both.withColumn("n", F.count("*").over(cell)).withColumn("rm", ranks(F.col("m"), F.col("obs"))).withColumn("ra", ranks(F.col("a"), F.col("obs")))
    low_m, low_a = F.floor(F.col("n") * logratio_trim) + 1, F.floor(F.col("n") * sum_trim) + 1
    kept = both.filter(F.col("rm").between(low_m, F.col("n") + 1 - low_m) & F.col("ra").between(low_a, F.col("n") + 1 - low_a))
    f = kept.groupBy("obs").agg(F.pow(F.lit(2.0), F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("f"))
    every = x.select("obs").distinct().join(f, "obs", "left").select("obs", F.coalesce("f", F.lit(1.0)).alias("f"))
    return _by_geometric_mean(every)


def offsets(x: DataFrame, factors: DataFrame) -> DataFrame:
    """(obs, offset): ln(factor * library size), 1 where it isn't finite."""
    value = F.ln(F.col("factor") * F.col("size"))
    return library_sizes(x).join(factors, "obs", "left").select("obs", F.coalesce(value, F.lit(1.0)).alias("offset"))



def factors_none(x: DataFrame) -> DataFrame:
    """(obs, factor): 1 for each cell."""
    return x.select("obs").distinct().withColumn("factor", F.lit(1.0))


def norm_factors(x: DataFrame, method: str = "TMM") -> DataFrame:
    """(obs, factor) by TMM, RLE, upper_quart or none."""
    ways = {"TMM": factors_tmm, "RLE": factors_rle, "upper_quart": factors_uq, "none": factors_none}
    if method not in ways:
        raise ValueError(f"method is one of {', '.join(ways)}")
    return ways[method](x)


def in_clusters(cells: DataFrame, clusters: list, column: str = "cluster") -> DataFrame:
    """Cells of the named clusters; an unknown cluster is an error."""
    known = {r[0] for r in cells.filter(F.col(column).isin(clusters)).select(column).distinct().collect()}  # at most the names asked for
    if missing := [c for c in clusters if c not in known]:
        raise KeyError(f"no cluster {missing[0]}")
    return cells.filter(F.col(column).isin(clusters))


def top_drivers(drivers: DataFrame, n: int, ascending: bool = False) -> DataFrame:
    """(lineage, var, corr, nth): the n features of largest (or least) correlation of each lineage; null ones take no part, ties by name."""
    order = F.col("corr").asc() if ascending else F.col("corr").desc()
    ranked = drivers.filter("corr IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("lineage").orderBy(order, "var")))
    return ranked.filter(F.col("nth") <= n).select("lineage", "var", "corr", "nth")


def driver_pairs(drivers: DataFrame, first: str, second: str, sets: dict[str, list[str]] | None = None) -> DataFrame:
    """(var, x, y, gene_set): each feature's correlation with two lineages, and the named set it is in, if any."""
    if first == second:
        raise ValueError("two lineages are needed")
    a, b = (drivers.filter(F.col("lineage") == name).select("var", F.col("corr").alias(c)) for name, c in ((first, "x"), (second, "y")))
    label = F.lit(None).cast("string")
    for name, members in (sets or {}).items():
        label = F.when(F.col("var").isin(members), F.lit(name)).otherwise(label)
    return a.join(b, "var").withColumn("gene_set", label)


def expression(layers: DataFrame, layer: str | None = None, variables: list | None = None, default: str = "X") -> DataFrame:
    """(obs, var, x) of one layer of a long table (obs, var, layer, x), of all features or the named ones; an unknown layer or feature is an error."""
    rows = layers.filter(F.col("layer") == (layer or default))
    if rows.isEmpty():
        raise KeyError(f"no layer {layer or default}")
    if variables is not None:
        rows = rows.filter(F.col("var").isin(variables))
        known = {r[0] for r in rows.select("var").distinct().collect()}  # at most the names asked for
        if missing := [v for v in variables if v not in known]:
            raise KeyError(f"no feature {missing[0]}")
    return rows.select("obs", "var", "x")


def without_missing(velocities: DataFrame) -> DataFrame:
    """(obs, var, v) of the features that have a value in every row: features with a null or NaN go."""
    bad = velocities.groupBy("var").agg(F.max(F.col("v").isNull() | F.isnan("v")).alias("bad")).filter("bad").select("var")
    return velocities.join(F.broadcast(bad), "var", "left_anti")


def clipped(c: Column, low: Column, high: Column) -> Column:
    """Values beyond the two set to them."""
    return F.least(F.greatest(c, low), high)


def percentile_ends(rows: DataFrame, column: str, percentile: tuple[float, float] | None = None) -> DataFrame:
    """One row (low, high): least and largest value, or two percentiles; NaN and null take no part."""
    own = rows.filter(F.col(column).isNotNull() & ~F.isnan(column))
    if percentile is None:
        return own.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return own.agg(*[F.expr(f"percentile(`{column}`, {p / 100})").alias(name) for name, p in zip(("low", "high"), sorted(percentile))])
