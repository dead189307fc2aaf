"""Fate tables: wide tables (i, one column for each lineage) and what is computed from them."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import ratio
from chainframe.operators.statistics import sorted_places


def _sum(columns) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out + c
    return out


def row_normalize(fates: DataFrame, names: list[str]) -> DataFrame:
    total = _sum(F.col(n) for n in names)
    return fates.withColumns({n: ratio(F.col(n), total) for n in names})


def mix(fates: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Columns by keys: "A, B" is the sum of both, under the name "A or B"; a lineage may stand in one key only."""
    used, out = set(), []
    for key in keys:
        own = [x.strip() for x in key.split(",")]
        if bad := [x for x in own if x not in names]:
            raise KeyError(f"no lineage {bad[0]}")
        if again := used.intersection(own):
            raise ValueError(f"{sorted(again)[0]} stands in two keys")
        used.update(own)
        out.append(_sum(F.col(x) for x in own).alias(" or ".join(own)))
    return fates.select("i", *out)


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns scaled to [0, 1] by their least and largest values (NaN and null take no part), one row that is broadcast."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    ends = rows.agg(*[f(clean[c]).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    scaled = {c: ratio(F.col(c) - F.col(f"_low_{c}"), F.col(f"_high_{c}") - F.col(f"_low_{c}")) for c in columns}
    return rows.crossJoin(F.broadcast(ends)).withColumns(scaled).select(rows.columns)


def priming(fates: DataFrame, names: list[str], method: str = "kl_divergence", early: Column | None = None) -> DataFrame:
    """(i, priming) in [0, 1]: divergence from the mean of (early) cells, or the largest entropy less the cell's. A row with a zero counts 1 before scaling.

    Means, least and largest values are grouped sums of one row, broadcast to the cells.
    """
    zero = _sum((F.col(n) == 0).cast("int") for n in names) > 0
    safe = {n: F.when(F.col(n) > 0, F.col(n)) for n in names}
    if method == "kl_divergence":
        seen = fates if early is None else fates.filter(early)
        mean = seen.agg(*[F.avg(n).alias(f"_{n}") for n in names])
        rows = fates.crossJoin(F.broadcast(mean))
        raw = _sum(safe[n] * F.ln(safe[n] / F.col(f"_{n}")) for n in names)
        rows = rows.select("i", F.when(zero, F.lit(1.0)).otherwise(raw).alias("raw"))
    elif method == "entropy":
        entropy = -_sum(F.coalesce(safe[n] * F.ln(safe[n]), F.lit(0.0)) for n in names)
        rows = fates.select("i", entropy.alias("e"))
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("e").alias("top")))).select("i", (F.col("top") - F.col("e")).alias("raw"))
    else:
        raise ValueError("method is kl_divergence or entropy")
    ends = rows.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return rows.crossJoin(F.broadcast(ends)).select("i", ratio(F.col("raw") - F.col("low"), F.col("high") - F.col("low")).alias("priming"))


def aggregate(fates: DataFrame, names: list[str], by: str) -> DataFrame:
    """(by, lineage, mean, sem): population deviation over the root of the number of rows, those with nulls included."""
    long = fates.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("lineage"), F.col(n).alias("p")) for n in names])).alias("x")).select(by, "x.*")
    return long.groupBy(by, "lineage").agg(F.avg("p").alias("mean"), (F.stddev_pop("p") / F.sqrt(F.count("*"))).alias("sem"))


def log_odds(fates: DataFrame, first: str, second: str | None = None) -> DataFrame:
    """(i, log_odds) of two lineages, or of one against the rest; rows where either is zero are left out."""
    a = F.col(first)
    b = F.col(second) if second else 1 - a
    return fates.filter((a != 0) & (b != 0)).select("i", F.ln(a / b + 1e-12).alias("log_odds"))


def circular(fates: DataFrame, names: list[str], by_mean: bool = True) -> DataFrame:
    """(i, x, y): each row as weights of points set evenly on the unit circle, after division by column means if `by_mean`."""
    rows = fates
    if by_mean:
        rows = rows.crossJoin(F.broadcast(rows.agg(*[F.avg(n).alias(f"_{n}") for n in names])))
        rows = rows.withColumns({n: ratio(F.col(n), F.col(f"_{n}")) for n in names})
    rows = row_normalize(rows, names)
    angle = [2 * math.pi * k / len(names) for k in range(len(names))]
    return rows.select("i", _sum(F.col(n) * math.cos(a) for n, a in zip(names, angle)).alias("x"), _sum(F.col(n) * math.sin(a) for n, a in zip(names, angle)).alias("y"))


def reduction_weights(fates: DataFrame, keep: list[str], rest: list[str], measure: str = "cosine", normalize: str = "softmax", beta: float = 1.0) -> DataFrame:
    """(key, other, weight): how much of each other lineage goes to each kept one. A few rows, by one aggregate over all cells.

    cosine: of the columns; equal: the same for all; kl and js: inverse divergence of column-normalized columns over rows without zeros.
    """
    pairs = [(k, r) for k in keep for r in rest]
    if measure == "equal":
        found = [F.lit(1.0) for _ in pairs]
        rows = fates
    elif measure == "cosine":
        rows = fates
        found = [ratio(F.sum(F.col(k) * F.col(r)), F.sqrt(F.sum(F.col(k) * F.col(k)) * F.sum(F.col(r) * F.col(r)))) for k, r in pairs]
    elif measure in ("kl", "js"):
        rows = fates.filter(_sum((F.col(n) == 0).cast("int") for n in keep + rest) == 0)
        sums = rows.agg(*[F.sum(n).alias(f"_{n}") for n in keep + rest])
        rows = rows.crossJoin(F.broadcast(sums)).withColumns({n: F.col(n) / F.col(f"_{n}") for n in keep + rest})
        found = []
        for k, r in pairs:
            p, q = F.col(k), F.col(r)
            if measure == "kl":
                found.append(ratio(F.lit(1.0), F.sum(q * F.ln(q / p))))
            else:
                m = (p + q) / 2
                found.append(ratio(F.lit(1.0), F.sqrt(F.sum(p * F.ln(p / m) + q * F.ln(q / m)) / 2)))
    else:
        raise ValueError("measure is cosine, equal, kl or js")
    wide = rows.agg(*[c.alias(f"w{n}") for n, c in enumerate(found)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(r).alias("other"), F.col(f"w{n}").alias("raw")) for n, (k, r) in enumerate(pairs)])).alias("x")).select("x.*")
    own = Window.partitionBy("other")
    if normalize == "softmax":
        e = F.exp(F.col("raw") * beta - F.max(F.col("raw") * beta).over(own))
        weight = e / F.sum(e).over(own)
    else:
        weight = ratio(F.col("raw"), F.sum("raw").over(own))
    return long.select("key", "other", weight.alias("weight"))


def reduce(fates: DataFrame, keep: list[str], rest: list[str], measure: str = "cosine", normalize: str = "softmax", beta: float = 1.0) -> DataFrame:
    """(i, kept lineages): the others' mass goes to the kept ones by `reduction_weights`; measure "scale" only rescales the kept ones."""
    if measure == "scale":
        return row_normalize(fates.select("i", *keep), keep)
    weights = {(r["key"], r["other"]): r["weight"] for r in reduction_weights(fates, keep, rest, measure, normalize, beta).collect()}
    return fates.select("i", *[(F.col(k) + _sum(F.col(r) * weights[k, r] for r in rest)).alias(k) for k in keep])


def discrete(fates: DataFrame, names: list[str], n: int, remove_overlap: bool = False) -> DataFrame:
    """(i, state): the n likeliest cells of each lineage, ties by id; a cell picked twice goes to its larger membership among those picked, or to none."""
    long = fates.select("i", F.explode(F.array(*[F.struct(F.lit(k).alias("rank_of"), F.lit(s).alias("state"), F.col(s).alias("p")) for k, s in enumerate(names)])).alias("x")).select("i", "x.*")
    picked = long.withColumn("r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("p"), "i"))).filter(F.col("r") <= n)
    cell = Window.partitionBy("i")
    if remove_overlap:
        return picked.withColumn("c", F.count("*").over(cell)).filter("c = 1").select("i", "state")
    return picked.withColumn("best", F.row_number().over(cell.orderBy(F.desc("p"), "rank_of"))).filter("best = 1").select("i", "state")


def map_labels(cells: DataFrame) -> DataFrame:
    """(query, label): each query label's most frequent reference label, ties and no overlap to the first; references used more than once get _1, _2, ...

    cells is (i, query, reference); nulls in either take no part.
    """
    queries, refs = (cells.filter(F.col(c).isNotNull()).select(c).distinct() for c in ("query", "reference"))
    counts = cells.filter("query IS NOT NULL AND reference IS NOT NULL").groupBy("query", "reference").agg(F.count("*").alias("c"))
    every = queries.crossJoin(F.broadcast(refs)).join(counts, ["query", "reference"], "left").fillna(0, ["c"])  # label dictionaries, not cells
    best = every.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("c"), "reference"))).filter("r = 1")
    same = Window.partitionBy("reference")
    nth, many = F.row_number().over(same.orderBy("query")), F.count("*").over(same)
    return best.select("query", F.when(many > 1, F.concat_ws("_", "reference", nth.cast("string"))).otherwise(F.col("reference").cast("string")).alias("label"))


def membership_peak(fates: DataFrame, names: list[str]) -> DataFrame:
    """(i, p): the largest of the memberships, each divided by its column's largest."""
    top = fates.agg(*[F.max(n).alias(f"_{n}") for n in names])
    rows = fates.crossJoin(F.broadcast(top))
    shares = [ratio(F.col(n), F.col(f"_{n}")) for n in names]
    return rows.select("i", (F.greatest(*shares) if len(shares) > 1 else shares[0]).alias("p"))


# ---- picking and reducing


def resolve(keys: list, names: list[str], default: str | None = None, unique: bool = True) -> list[str]:
    """Lineages by name or place (from 0, negative from the end), in order, each once if `unique`; an unknown one is the default, or an error."""
    out = []
    for key in keys:
        if isinstance(key, int) and not isinstance(key, bool):
            if not -len(names) <= key < len(names):
                raise IndexError(f"no lineage {key}")
            key = names[key]
        elif key not in names:
            if default is None:
                raise KeyError(f"no lineage {key}")
            key = default
        if not unique or key not in out:
            out.append(key)
    return out


def pick(fates: DataFrame, names: list[str], keys: list | None = None, cells: DataFrame | Column | None = None) -> DataFrame:
    """(i, lineages by keys): names and places in the order given, each once; keys with commas are mixed. cells is a table (i) or a condition."""
    if cells is not None:
        fates = fates.filter(cells) if isinstance(cells, Column) else fates.join(cells.select("i"), "i", "left_semi")
    if keys is None:
        return fates.select("i", *names)
    if any(isinstance(k, str) and "," in k for k in keys):
        return mix(fates, names, [names[k] if isinstance(k, int) else k for k in keys])
    return fates.select("i", *resolve(keys, names))


def pick_each(fates: DataFrame, names: list[str], pairs: DataFrame) -> DataFrame:
    """(i, mixture) of pairs (i, lineage): for each pair the cell's probability of that lineage."""
    own = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return pairs.join(fates, "i").select("i", F.element_at(own, F.col("lineage")).alias("mixture"))


_ROW = {
    "sum": lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v),
    "mean": lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x),
    "min": F.array_min,
    "max": F.array_max,
    "argmin": lambda x: (F.array_position(x, F.array_min(x)) - 1).cast("double"),
    "argmax": lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("double"),
    "var": lambda x: _row_var(x),
    "std": lambda x: F.sqrt(_row_var(x)),
    "entropy": lambda x: _row_entropy(x),
}


def _row_var(x: Column) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / F.size(x)


def _row_entropy(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(x, F.lit(0.0), lambda s, v: s - F.when(v > 0, v / total * F.ln(v / total)).otherwise(0.0))


def _column_entropy(c: Column) -> Column:
    # -sum p/S ln(p/S) = ln S - sum(p ln p) / S
    return F.ln(F.sum(c)) - F.sum(F.when(c > 0, c * F.ln(c)).otherwise(0.0)) / F.sum(c)


_COLUMN = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "var": F.var_pop, "std": F.stddev_pop, "entropy": _column_entropy}


def reduce_rows(fates: DataFrame, names: list[str], how: str) -> DataFrame:
    """(i, one column named "<how> of A, B, ..."): sum, mean, min, max, argmin, argmax (places from 0), var, std or entropy over each cell's lineages."""
    if how not in _ROW:
        raise ValueError(f"how is one of {', '.join(_ROW)}")
    return fates.select("i", _ROW[how](F.array(*names)).alias(f"{how} of {', '.join(names)}"))


def reduce_columns(fates: DataFrame, names: list[str], how: str) -> DataFrame:
    """One row with a column "<how> of A" for each lineage A, over all cells; argmin and argmax give the cell, of equals the smallest."""
    if how in ("argmin", "argmax"):
        found = [(F.min_by("i", F.struct(n, "i")) if how == "argmin" else F.max_by("i", F.struct(F.col(n), -F.col("i")))).alias(f"{how} of {n}") for n in names]
    elif how in _COLUMN:
        found = [_COLUMN[how](F.col(n)).alias(f"{how} of {n}") for n in names]
    else:
        raise ValueError(f"how is argmin, argmax or one of {', '.join(_COLUMN)}")
    return fates.agg(*found)


def sort_rows(fates: DataFrame, names: list[str]) -> DataFrame:
    """(i, x0, x1, ...): each cell's probabilities in rising order."""
    return fates.select("i", F.array_sort(F.array(*names)).alias("x")).select("i", *[F.col("x")[k].alias(f"x{k}") for k in range(len(names))])


def shares(fates: DataFrame, names: list[str], reduction="mean", by: str | None = None) -> DataFrame:
    """(by, lineage, share): each lineage reduced over the cells (of a group), then divided by the total; reduction is a name as in `reduce_columns` or a function of a column."""
    f = _COLUMN[reduction] if isinstance(reduction, str) else reduction
    rows = fates.groupBy(*([by] if by else [])).agg(*[f(F.col(n)).alias(n) for n in names])
    total = _sum(F.col(n) for n in names)
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("lineage"), ratio(F.col(n), total).alias("share")) for n in names])).alias("x")
    return rows.select(*([by] if by else []), one).select(*([by] if by else []), "x.*")


def column_normalize(fates: DataFrame, names: list[str], order: int = 2) -> DataFrame:
    """Each lineage divided by its norm over all cells: the root of the sum of squares, or the sum of sizes for order 1."""
    norms = fates.agg(*[(F.sqrt(F.sum(F.col(n) ** 2)) if order == 2 else F.sum(F.abs(n))).alias(f"_{n}") for n in names])
    return fates.crossJoin(F.broadcast(norms)).withColumns({n: ratio(F.col(n), F.col(f"_{n}")) for n in names}).select(fates.columns)


def softmax_rows(fates: DataFrame, names: list[str], beta: float = 1.0) -> DataFrame:
    """Each cell's probabilities as exp(beta p) over their sum."""
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    e = {n: F.exp(beta * (F.col(n) - top)) for n in names}
    total = _sum(e.values())
    return fates.select("i", *[(e[n] / total).alias(n) for n in names])


def early_cells(cells: DataFrame, spec) -> DataFrame:
    """(i) of cells by a condition, a list of ids, or {column: values}."""
    if isinstance(spec, Column):
        return cells.filter(spec).select("i")
    if isinstance(spec, dict):
        if len(spec) != 1:
            raise ValueError("one column is needed")
        ((column, values),) = spec.items()
        return cells.filter(F.col(column).isin(list(values))).select("i")
    return cells.filter(F.col("i").isin(list(spec))).select("i")


def above_threshold(odds: DataFrame, values: DataFrame, threshold: float | None = None) -> DataFrame:
    """(i, log_odds, value, above): values (i, value) beside log-odds, and whether they are above a threshold (null without one)."""
    rows = odds.join(values.select("i", "value"), "i", "left").fillna(0.0, ["value"])
    return rows.withColumn("above", F.lit(None).cast("boolean") if threshold is None else F.col("value") > threshold)


# ---- distances between lineages


def wasserstein(fates: DataFrame, first: str, second: str) -> DataFrame:
    """One row (distance): the mean gap between both columns' sorted values. Places come from sorts by range, so neither column is one task's work."""
    long = [fates.select(F.lit(0).alias("one"), "i", F.col(n).alias("v")) for n in (first, second)]
    a, b = (sorted_places(x, "one", ["v", "i"], "r") for x in long)
    return a.select("r", F.col("v").alias("a")).join(b.select("r", F.col("v").alias("b")), "r").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("distance"))


def distances(fates: DataFrame, names: list[str], metric="correlation") -> list[list[float]]:
    """Between all pairs of lineage columns: correlation, cosine, euclidean, a function of two columns giving an aggregate, or a given matrix.

    One aggregate over the cells; the result has a row for each lineage.
    """
    if not isinstance(metric, str) and not callable(metric):
        given = [[float(x) for x in row] for row in metric]
        if len(given) != len(names) or any(len(row) != len(names) for row in given):
            raise ValueError("the matrix needs a row and a column for each lineage")
        return given
    ways = {
        "correlation": lambda a, b: 1 - F.corr(a, b),
        "cosine": lambda a, b: 1 - ratio(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))),
        "euclidean": lambda a, b: F.sqrt(F.sum((a - b) * (a - b))),
    }
    f = ways[metric] if isinstance(metric, str) else metric
    pairs = [(k, n) for k in range(len(names)) for n in range(k)]
    row = fates.agg(*[f(F.col(names[k]), F.col(names[n])).alias(f"d{k}_{n}") for k, n in pairs]).first() if pairs else []
    out = [[0.0] * len(names) for _ in names]
    for (k, n), d in zip(pairs, row):
        out[k][n] = out[n][k] = float(d)
    return out


def shortest_tour(distance: list[list[float]]) -> tuple[float, list[int]]:
    """Length and order, from 0, of the shortest closed tour: dynamic programming over subsets, for at most 20 places."""
    n = len(distance)
    if n > 20:
        raise ValueError("at most 20 lineages")
    if n < 2:
        return 0.0, list(range(n))
    best = {(1 << k, k): (distance[0][k], 0) for k in range(1, n)}  # visited set, last place: length, place before
    for size in range(2, n):
        for chosen in combinations(range(1, n), size):
            bits = sum(1 << k for k in chosen)
            for k in chosen:
                best[bits, k] = min((best[bits ^ 1 << k, j][0] + distance[j][k], j) for j in chosen if j != k)
    bits = (1 << n) - 2
    length, last = min((best[bits, k][0] + distance[k][0], k) for k in range(1, n))
    order = []
    while bits:
        order.append(last)
        bits, last = bits ^ 1 << last, best[bits, last][1]
    return length, [0, *order[::-1]]


def circular_order(fates: DataFrame, names: list[str], metric="correlation") -> list[str]:
    """Lineages in the order of the shortest tour by their distances, for `circular`."""
    return [names[k] for k in shortest_tour(distances(fates, names, metric))[1]]
