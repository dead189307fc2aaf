"""Smoothed trends of features along time, one model for each feature and lineage, fitted in grouped Arrow functions.

A group is the cells of one feature in one lineage. P-splines by penalized iteratively reweighted least
squares stand for generalized additive models; a failed fit gives a row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import ratio
from chainframe.operators import spectral

SCHEMA = "var string, lineage string, t double, y double, low double, high double, error string"


def knots(times: np.ndarray, n: int, uniform: bool = False) -> np.ndarray:
    """n knot places: even between the ends, or quantiles in which runs of equal ones are spread evenly up to the next."""
    times = np.asarray(times, float)
    if n < 1:
        raise ValueError("at least one knot is needed")
    if uniform or n == 1:
        return np.linspace(times.min(), times.max(), n)[-n:] if n > 1 else np.array([times.max()])
    found = np.quantile(times, np.linspace(0, 1, n))
    out, at = found.copy(), 0
    while at < n:
        end = at
        while end + 1 < n and found[end + 1] == found[at]:
            end += 1
        if end > at:
            if end + 1 < n:
                out[at : end + 2] = np.linspace(found[at], found[end + 1], end - at + 2)
            else:
                out[at - 1 if at else at : end + 1] = np.linspace(out[at - 1] if at else found[at], found[end], end - at + 2 if at else end + 1)
        at = end + 1
    return out


def basis(x: np.ndarray, places: np.ndarray, order: int = 3) -> np.ndarray:
    """B-splines of degree `order` over even knots between the ends of places."""
    inner = max(len(places) - 1, 1)
    low, high = places[0], places[-1]
    step = (high - low) / inner or 1.0
    grid = low + step * np.arange(-order, inner + order + 1)
    x = np.clip(x, low, high)[:, None]
    b = ((x >= grid[:-1]) & (x < grid[1:])).astype(float)
    b[x[:, 0] >= grid[-order - 1], :] = 0
    b[x[:, 0] >= grid[-order - 1], inner + order - 1] = 1
    for d in range(1, order + 1):
        left = (x - grid[: -d - 1]) / (grid[d:-1] - grid[: -d - 1])
        right = (grid[d + 1 :] - x) / (grid[d + 1 :] - grid[1:-d])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


_LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: np.ones_like(e)),
    "log": (np.log, lambda e: np.exp(np.clip(e, -30, 30)), lambda e: np.exp(np.clip(e, -30, 30))),
    "logit": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-np.clip(e, -30, 30))), lambda e: np.exp(-np.clip(e, -30, 30)) / (1 + np.exp(-np.clip(e, -30, 30))) ** 2),
}
_VARIANCES = {"gaussian": lambda m: np.ones_like(m), "poisson": lambda m: m, "gamma": lambda m: m**2, "inv_gauss": lambda m: m**3, "binomial": lambda m: m * (1 - m)}


def checked(x, y, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three as equally long vectors of numbers, or an error."""
    x, y, w = (np.asarray(v, float).reshape(-1) for v in (x, y, w))
    if not len(x) == len(y) == len(w):
        raise ValueError(f"lengths differ: {len(x)}, {len(y)}, {len(w)}")
    if not len(x):
        raise ValueError("no cells")
    return x, y, w


def best_penalty(x, y, w, penalties: list[float], **options) -> float:
    """Of the penalties, that of least generalized cross-validation score of the fitted spline, ties to the larger."""
    def score(penalty: float) -> float:
        fitted, freedom = _fitted(x, y, w, penalty=penalty, **options)
        return float((w * (y - fitted) ** 2).sum() * w.sum() / max(w.sum() - freedom, 1e-9) ** 2)

    return min(sorted(penalties, reverse=True), key=score)


def _fitted(x, y, w, **options) -> tuple[np.ndarray, float]:
    """Predictions at x, and degrees of freedom."""
    freedom: list[float] = []
    mean, _, _ = fit_spline(x, y, w, x, freedom_to=freedom, **options)
    return mean, freedom[0]


def fit_spline(x, y, w, grid, n_knots: int = 6, order: int = 3, distribution: str = "gaussian", link: str = "identity", penalty: float | list[float] = 0.6, expectile: float | None = None, level: float = 0.95, max_steps: int = 100, freedom_to: list | None = None):
    """(y, low, high) on the grid: a penalized spline and its interval of that level. A list of penalties is searched, see `best_penalty`."""
    x, y, w = checked(x, y, w)
    if isinstance(penalty, (list, tuple)):
        penalty = best_penalty(x, y, w, list(penalty), n_knots=n_knots, order=order, distribution=distribution, link=link, expectile=expectile, max_steps=max_steps)
    to_link, inverse, slope = _LINKS[link]
    places = knots(np.r_[x, grid], max(n_knots, 2), uniform=True)
    b, g = basis(x, places, order), basis(grid, places, order)
    diff = np.diff(np.eye(b.shape[1]), 2, axis=0)
    ridge = penalty * diff.T @ diff + 1e-8 * np.eye(b.shape[1])
    start = {"identity": y, "log": np.clip(y, 1e-3, None), "logit": (np.clip(y, 0, 1) + 0.5) / 2}[link]
    eta = to_link(start)
    beta = np.zeros(b.shape[1])
    for _ in range(max_steps):
        mean = inverse(eta)
        d = slope(eta)
        weight = w * d * d / np.maximum(_VARIANCES[distribution](mean), 1e-12)
        if expectile is not None:
            weight = weight * np.where(y > mean, expectile, 1 - expectile)
        z = eta + (y - mean) / np.where(np.abs(d) < 1e-12, 1e-12, d)
        inner = b.T @ (weight[:, None] * b)
        new = np.linalg.solve(inner + ridge, b.T @ (weight * z))
        moved, beta = np.abs(new - beta).max(), new
        eta = b @ beta
        if moved < 1e-8:
            break
    cov = np.linalg.inv(inner + ridge)
    freedom = np.trace(cov @ inner)
    if freedom_to is not None:
        freedom_to.append(float(freedom))
    mean = inverse(eta)
    spread = (w * (y - mean) ** 2 / np.maximum(_VARIANCES[distribution](mean), 1e-12)).sum() / max(w.sum() - freedom, 1)
    half = NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", g, cov, g) * spread, 0))
    e = g @ beta
    return inverse(e), inverse(e - half), inverse(e + half)


def default_interval(x: np.ndarray, y: np.ndarray, fitted: np.ndarray, w: np.ndarray, grid: np.ndarray, on_grid: np.ndarray):
    """The interval of a model without one: half-width sigma * sqrt(1 + 1/n + (t - mean)^2 / S) / 2, n and sigma over cells of positive weight."""
    used = w > 0
    n = used.sum()
    sigma = np.sqrt(((y - fitted)[used] ** 2).sum() / max(n - 2, 1))
    centre = x.mean()
    half = sigma * np.sqrt(1 + 1 / n + (grid - centre) ** 2 / max(((x - centre) ** 2).sum(), 1e-300)) / 2
    return on_grid - half, on_grid + half


def prepared(rows: pd.DataFrame, n_points: int, weight_floor: float = 0.01, floor_to: float = 0.01, width: int = 5) -> tuple[np.ndarray, ...]:
    """(x, y, w, grid) of rows (t, y, w): one row for each time, small weights set to a floor, and a grid that ends where smoothed weights peak."""
    rows = rows.dropna(subset=["t", "y", "w"]).sort_values("t").drop_duplicates("t")
    x, y, w = (rows[c].to_numpy(float) for c in ("t", "y", "w"))
    if not len(x):
        raise ValueError("no cells")
    w = np.where(w < weight_floor, floor_to, w)
    if w.min() == w.max():
        end = x.max()
    else:
        pad = np.pad(w, (width // 2, width - 1 - width // 2), mode="edge")
        end = x[int(np.argmax(np.convolve(pad, np.ones(width) / width, "valid")))]
    low, high = x.min(), end if end > x.min() else x.max()
    return x, y, w, np.linspace(low, high, n_points)


def chosen(config: dict, var: str, lineage: str):
    """The entry for a feature and lineage of {feature: {lineage: entry}}, where "*" stands for all not named and an inner entry may stand for all lineages; an error if there is none."""
    for name in (var, "*"):
        if name in config:
            own = config[name]
            if not isinstance(own, dict):
                return own
            for key in (lineage, "*"):
                if key in own:
                    return own[key]
    raise KeyError(f"no entry for {var}, {lineage}")


def _each(config, var: str, lineage: str):
    return chosen(config, var, lineage) if isinstance(config, dict) else config


def fit_trends(cells: DataFrame, n_points: int = 50, model: Callable | dict | None = None, prepare: Callable | dict | None = None, **options) -> DataFrame:
    """Trends of cells (var, lineage, t, y, w) on n_points times each: splines by default, or model(x, y, w, grid) -> predictions on grid and on x.

    model and prepare may be {feature: {lineage: function}} with "*" for all others, see `chosen`; prepare(x, y, w, grid) gives the four anew before the fit.
    A group is the cells of one feature in one lineage and is fitted in one task; for groups beyond that see `fit_trends_by_sums`. A failed group gives one row with its error.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        var, lineage = str(rows["var"].iloc[0]), str(rows["lineage"].iloc[0])
        try:
            x, y, w, grid = prepared(rows, n_points)
            if (own := _each(prepare, var, lineage)) is not None:
                x, y, w, grid = own(x, y, w, grid)
                x, y, w = checked(x, y, w)
            if (own := _each(model, var, lineage)) is None:
                mean, low, high = fit_spline(x, y, w, grid, **options)
            else:
                mean, fitted = (np.asarray(v, float) for v in own(x, y, w, grid))
                if len(mean) != len(grid) or len(fitted) != len(x):
                    raise ValueError("a model predicts on the grid and at the cells")
                low, high = default_interval(x, y, fitted, w, grid, mean)
            return pd.DataFrame({"var": var, "lineage": lineage, "t": grid, "y": mean, "low": low, "high": high, "error": None})
        except Exception as error:  # kept as a row: one feature must not end the job
            return pd.DataFrame({"var": [var], "lineage": [lineage], "t": [None], "y": [None], "low": [None], "high": [None], "error": [f"{type(error).__name__}: {error}"]})

    return cells.groupBy("var", "lineage").applyInPandas(fit, SCHEMA)


def fit_trends_by_sums(cells: DataFrame, n_points: int = 50, n_knots: int = 6, penalty: float = 0.6, level: float = 0.95) -> DataFrame:
    """The Gaussian splines of `fit_spline` for groups of any size: (var, lineage, t, y, low, high, error) from grouped sums of products of basis functions.

    Cells (var, lineage, t, y, w) with nulls take no part. Cubic basis functions over even knots between a group's first and last time are columns; one aggregate gives
    each group's normal equations, a row of some sixty numbers, which is then solved. A group with one time only gives a row with its error.
    """
    m, inner = n_knots - 1 + 3, n_knots - 1
    cells = cells.filter("t IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL")
    ends = cells.groupBy("var", "lineage").agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    rows = cells.join(ends, ["var", "lineage"])
    step = (F.col("_high") - F.col("_low")) / inner

    def piece(k: int) -> Column:
        x = ratio(F.col("t") - F.col("_low"), step) + 3 - k
        total = F.lit(0.0)
        for j, c in enumerate((1, -4, 6, -4, 1)):
            total = total + c * F.pow(F.greatest(x - j, F.lit(0.0)), F.lit(3.0)) / 6
        return F.when((x >= 0) & (x <= 4), total).otherwise(0.0)

    rows = rows.select("var", "lineage", "y", "w", "_low", "_high", *[piece(k).alias(f"_b{k}") for k in range(m)])
    pairs = [(k, n) for k in range(m) for n in range(k, m)]
    sums = [F.sum(F.col("w") * F.col(f"_b{k}") * F.col(f"_b{n}")).alias(f"a{k}_{n}") for k, n in pairs] + [F.sum(F.col("w") * F.col(f"_b{k}") * F.col("y")).alias(f"c{k}") for k in range(m)]
    table = rows.groupBy("var", "lineage").agg(F.first("_low").alias("low"), F.first("_high").alias("high"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y") ** 2).alias("syy"), *sums)
    table = table.withColumn("var", F.col("var").cast("string")).withColumn("lineage", F.col("lineage").cast("string"))

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ridge = penalty * np.diff(np.eye(m), 2, axis=0).T @ np.diff(np.eye(m), 2, axis=0) + 1e-8 * np.eye(m)
        for batch in batches:
            for r in batch.to_dict("records"):
                if not r["high"] > r["low"]:
                    yield pd.DataFrame({"var": [r["var"]], "lineage": [r["lineage"]], "t": [None], "y": [None], "low": [None], "high": [None], "error": ["ValueError: one time only"]})
                    continue
                a, c = np.zeros((m, m)), np.array([r[f"c{k}"] for k in range(m)])
                for k, n in pairs:
                    a[k, n] = a[n, k] = r[f"a{k}_{n}"]
                cov = np.linalg.inv(a + ridge)
                beta, grid = cov @ c, np.linspace(r["low"], r["high"], n_points)
                g = basis(grid, np.linspace(r["low"], r["high"], n_knots))
                spread = max(r["syy"] - 2 * beta @ c + beta @ a @ beta, 0) / max(r["sw"] - np.trace(cov @ a), 1)
                half = NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", g, cov, g) * spread, 0))
                yield pd.DataFrame({"var": r["var"], "lineage": r["lineage"], "t": grid, "y": g @ beta, "low": g @ beta - half, "high": g @ beta + half, "error": None})

    return table.mapInPandas(solved, SCHEMA)


def trend_cells(x: DataFrame, fates: DataFrame, times: DataFrame, names: list[str], t_range: tuple | None = None, least: float | None = None) -> DataFrame:
    """(var, lineage, t, y, w) for `fit_trends` of features (obs, var, x), fates (i, names...) as weights and times (i, t).

    Each feature has a row for each cell, 0 where it is absent; cells outside the time range, or with expression below `least`, take no part.
    """
    cells = times.join(fates, "i")
    if t_range is not None:
        cells = cells.filter(F.col("t").between(*t_range))
    variables = x.select("var").distinct()
    grid = cells.crossJoin(F.broadcast(variables)) if least is None else cells.join(x.select(F.col("obs").alias("i"), "var").distinct(), "i")
    full = grid.join(x.select(F.col("obs").alias("i"), "var", F.col("x").alias("y")), ["i", "var"], "left").fillna(0.0, ["y"])
    if least is not None:
        full = full.filter(F.col("y") >= least)
    lineage = F.explode(F.array(*[F.struct(F.lit(n).alias("lineage"), F.col(n).alias("w")) for n in names])).alias("z")
    return full.select(F.col("var").cast("string").alias("var"), "t", "y", lineage).select("var", "z.lineage", "t", "y", "z.w")


def succeeded(trends: DataFrame, drop_all_failed: bool = True) -> DataFrame:
    """Trends without failed rows; features, and lineages, of which nothing succeeded are an error unless they may be dropped."""
    good = trends.filter("error IS NULL")
    for key in ("var", "lineage"):
        lost = trends.select(key).distinct().join(good.select(key).distinct(), key, "left_anti").limit(1).collect()
        if lost and not drop_all_failed:
            raise RuntimeError(f"nothing succeeded for {key} {lost[0][0]}")
    if good.isEmpty():
        raise RuntimeError("no trend succeeded")
    return good


def wide(trends: DataFrame, by: str = "lineage") -> DataFrame:
    """(the other of var and lineage, t, nth, a column for each feature or lineage): trends side by side by their n-th time."""
    other = "var" if by == "lineage" else "lineage"
    placed = trends.withColumn("nth", F.row_number().over(Window.partitionBy("var", "lineage").orderBy("t")))
    return placed.groupBy(other, "nth").pivot(by).agg(F.first("y"))


def scaled(trends: DataFrame) -> DataFrame:
    """Each trend with its interval, scaled by the least and largest value of the three."""
    group = Window.partitionBy("var", "lineage")
    low, high = F.min(F.least("y", "low", "high")).over(group), F.max(F.greatest("y", "low", "high")).over(group)
    return trends.withColumn("_a", low).withColumn("_z", high).withColumns({c: ratio(F.col(c) - F.col("_a"), F.col("_z") - F.col("_a")) for c in ("y", "low", "high")}).drop("_a", "_z")


def standardized(trends: DataFrame) -> DataFrame:
    """Each trend less its mean over its population deviation; a constant one is 0."""
    group = Window.partitionBy("var", "lineage")
    return trends.withColumn("y", ratio(F.col("y") - F.avg("y").over(group), F.stddev_pop("y").over(group)))


def cluster_trends(trends: DataFrame, method: str = "propagation", k: int | None = None, neighbours: int = 15, normalize: bool = True, seed: int = 0) -> DataFrame:
    """(var, cluster) of one lineage's trends (var, t, y): trends on their common places, standardized, grouped by `spectral.clusters`. A row for each feature."""
    rows = standardized(trends) if normalize else trends
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("var").orderBy("t")))
    n = placed.agg(F.max("nth")).first()[0]
    if not n:
        raise ValueError("no trends")
    features = placed.groupBy("var").agg(*[F.max(F.when(F.col("nth") == q, F.col("y"))).alias(f"y{q}") for q in range(1, n + 1)]).fillna(0.0)
    numbered = features.withColumn("i", F.row_number().over(Window.orderBy("var")).cast("long"))  # a row for each feature
    found = spectral.clusters(numbered, [f"y{q}" for q in range(1, n + 1)], method, k, neighbours, seed)
    return numbered.select("i", "var").join(found, "i").select("var", "cluster")


def cluster_means(trends: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, nth, t, mean, sd) of the trends of each cluster at each place."""
    placed = trends.withColumn("nth", F.row_number().over(Window.partitionBy("var").orderBy("t")))
    return placed.join(clusters, "var").groupBy("cluster", "nth").agg(F.avg("t").alias("t"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))


def linear_interval(cells: DataFrame) -> DataFrame:
    """(var, t, y, low, high): a straight line by least squares and its default interval at each cell's time, from grouped sums of (var, t, y)."""
    sums = cells.groupBy("var").agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("base"), F.count("*").alias("n"), F.avg("t").alias("centre"), F.regr_sxx("y", "t").alias("sxx"), F.regr_syy("y", "t").alias("syy"), F.regr_sxy("y", "t").alias("sxy"))
    sigma = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1)))
    rows = cells.join(sums, "var")
    line = F.col("base") + F.col("slope") * F.col("t")
    half = sigma * F.sqrt(1 + 1 / F.col("n") + F.try_divide((F.col("t") - F.col("centre")) ** 2, F.col("sxx"))) / 2
    return rows.select("var", "t", line.alias("y"), (line - half).alias("low"), (line + half).alias("high"))
