"""Additive models of any size, all features and lineages at once: cubic P-splines by iteratively reweighted least squares over grouped sums.

A cell touches four neighbouring basis functions only, so a step is one aggregate by feature, lineage and interval between knots: ten products,
four right sides and a few scalars, combined before the shuffle. No group is in one task, and what is solved in Python is one small matrix a group.
Fitted models are a table of coefficients, from which trends are predicted anew at any time.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainframe.functions.arrays import ratio
from chainframe.functions.special import digamma, trigamma
from chainframe.lineage import cut, release
from chainframe.operators.trends import basis

KEYS = ["var", "lineage", "penalty"]
COEFFICIENTS = "var string, lineage string, penalty double, low double, high double, beta array<double>, cov array<double>, theta double, spread double, freedom double, gcv double, steps int, settled boolean, error string"

#: Groups up to which their coefficients are broadcast (some 500 bytes each); beyond it rows meet them by a shuffle over salted keys.
BROADCAST_GROUPS, SALTS = 100_000, 32

_PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]

_LINKS = {  # link of a mean, mean of a predictor, slope of the mean
    "identity": (lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "log": (F.ln, lambda e: F.exp(_within(e, -30.0, 30.0)), lambda e: F.exp(_within(e, -30.0, 30.0))),
    "logit": (lambda m: F.ln(m / (1 - m)), lambda e: 1 / (1 + F.exp(-_within(e, -30.0, 30.0))), lambda e: F.exp(-_within(e, -30.0, 30.0)) / (1 + F.exp(-_within(e, -30.0, 30.0))) ** 2),
}
_VARIANCES = {
    "gaussian": lambda m, theta: F.lit(1.0),
    "poisson": lambda m, theta: m,
    "gamma": lambda m, theta: m**2,
    "inv_gauss": lambda m, theta: m**3,
    "binomial": lambda m, theta: m * (1 - m),
    "negative_binomial": lambda m, theta: m + m * m / theta,
}
_LEAST_LOG, _MOST_LOG = -7.0, 12.0  # of the size parameter of the negative binomial; at the upper end it is a Poisson


def _within(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _met(rows: DataFrame, table: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Rows with the table's entry of their key: broadcast if it is small, else by shuffled keys with salt, so that a hot key fills many tasks."""
    if small:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("t", "y", "w"), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def _placed(cells: DataFrame, ends: DataFrame, n_knots: int, small: bool) -> DataFrame:
    """Cells with their interval s and four basis values."""
    inner = n_knots - 1
    x = ratio(F.col("t") - F.col("low"), (F.col("high") - F.col("low")) / inner)
    s = F.least(F.floor(x), F.lit(inner - 1)).cast("int")
    rows = _met(cells, ends, ["var", "lineage"], small).filter("high > low").withColumn("s", s).withColumn("u", x - F.col("s"))
    u = F.col("u")
    values = ((1 - u) ** 3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6, (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, u**3 / 6)
    return rows.select("var", "lineage", "t", "y", "w", "o", "s", *[v.alias(f"b{k}") for k, v in enumerate(values)])


def _formulas(distribution: str, link: str, expectile: float | None) -> tuple[list[dict], list[Column]]:
    """(columns added in turn, sums of them) of a step."""
    to_link, inverse, slope = _LINKS[link]
    y, w, o, eta, mean, d, theta, variance = (F.col(c) for c in ("y", "w", "o", "eta", "mean", "d", "theta", "variance"))
    start = y if link == "identity" else F.greatest(y, F.lit(1e-3)) if link == "log" else (_within(y, 0.0, 1.0) + 0.5) / 2
    fitted = o + sum((F.col(f"b{k}") * F.get("beta", F.col("s") + k) for k in range(4)), F.lit(0.0))
    weight = w * d * d / variance
    if expectile is not None:
        weight = weight * F.when(y > mean, expectile).otherwise(1 - expectile)
    added = [
        {"eta": F.when(F.col("beta").isNull(), to_link(start)).otherwise(fitted)},
        {"mean": inverse(eta), "d": slope(eta)},
        {"variance": F.greatest(_VARIANCES[distribution](mean, theta), F.lit(1e-12))},
        {"k": weight, "z": eta - o + (y - mean) / F.when(F.abs(d) < 1e-12, 1e-12).otherwise(d)},
    ]
    sums = [F.sum(F.col("k") * F.col(f"b{a}") * F.col(f"b{b}")).alias(f"a{a}{b}") for a, b in _PAIRS]
    sums += [F.sum(F.col("k") * F.col("z") * F.col(f"b{a}")).alias(f"c{a}") for a in range(4)]
    sums += [F.sum(w).alias("sw"), F.sum(w * (y - mean) ** 2).alias("rss"), F.sum(w * (y - mean) ** 2 / variance).alias("pearson")]
    if distribution == "negative_binomial":  # score and information of the size parameter
        both = mean + theta
        sums.append(F.sum(w * (digamma(y + theta) - digamma(theta) + F.ln(theta / both) + 1 - (y + theta) / both)).alias("score"))
        sums.append(F.sum(w * (trigamma(theta) - trigamma(y + theta) - 1 / theta + 2 / both - (y + theta) / both**2)).alias("info"))
    return added, sums


def _sums(rows: DataFrame, state: DataFrame, formulas: tuple[list[dict], list[Column]], small: bool) -> DataFrame:
    """(keys, list of the sums of each interval) at the state's coefficients; the first time, at the data."""
    met = _met(rows, state.select(*KEYS, "beta", "theta"), ["var", "lineage"], small)
    for columns in formulas[0]:
        met = met.withColumns(columns)
    by_interval = met.groupBy(*KEYS, "s").agg(*formulas[1])
    names = [c for c in by_interval.columns if c not in KEYS]
    return by_interval.groupBy(*KEYS).agg(F.collect_list(F.struct(*names)).alias("sums"))  # as many as there are intervals


def _penalty_matrix(n_knots: int, natural: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the penalty of 1, a basis of the coefficients allowed)."""
    m = n_knots + 2
    second = np.diff(np.eye(m), 2, axis=0)
    if not natural:
        return second.T @ second, np.eye(m)
    mass = np.diag(np.full(n_knots, 2 / 3)) + np.diag(np.full(n_knots - 1, 1 / 6), 1) + np.diag(np.full(n_knots - 1, 1 / 6), -1)
    ends = second[[0, -1]]  # the second derivative at both ends is 0
    return second.T @ mass @ second, np.linalg.svd(ends)[2][2:].T


def _stepped(table: DataFrame, n_knots: int, natural: bool, negative: bool, tolerance: float) -> DataFrame:
    """The next state of each group from its sums and its last state."""
    m = n_knots + 2

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, free = _penalty_matrix(n_knots, natural)
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                a, c = np.zeros((m, m)), np.zeros(m)
                total = {name: sum(q[name] for q in r["sums"]) for name in ("sw", "rss", "pearson", *(("score", "info") if negative else ()))}
                for q in r["sums"]:
                    for x, y in _PAIRS:
                        a[q["s"] + x, q["s"] + y] += q[f"a{x}{y}"]
                    c[q["s"] : q["s"] + 4] += [q[f"c{x}"] for x in range(4)]
                a = a + np.triu(a, 1).T
                try:
                    if not (np.isfinite(a).all() and np.isfinite(c).all()):
                        raise ValueError("the fit diverged")
                    inverse = np.linalg.inv(free.T @ (a + r["penalty"] * unit + 1e-8 * np.eye(m)) @ free)
                    cov = free @ inverse @ free.T
                    beta = cov @ c
                    moved = np.inf if r["beta"] is None else np.abs(beta - np.asarray(r["beta"])).max()
                    theta = r["theta"]
                    if negative and r["beta"] is not None:
                        score, info = theta * total["score"], theta**2 * total["info"] - theta * total["score"]
                        move = np.clip(score / info, -1, 1) if info > 0 else np.sign(score)
                        log = np.clip(np.log(theta) + move, _LEAST_LOG, _MOST_LOG)
                        moved, theta = max(moved, abs(log - np.log(theta))), float(np.exp(log))
                    freedom = float(np.trace(cov @ a))
                    spread = 1.0 if negative else total["pearson"] / max(total["sw"] - freedom, 1)
                    gcv = total["rss"] * total["sw"] / max(total["sw"] - freedom, 1e-9) ** 2
                    new = {"beta": beta.tolist(), "cov": cov.ravel().tolist(), "theta": theta, "spread": spread, "freedom": freedom, "gcv": gcv, "settled": bool(moved < tolerance), "error": None}
                except (ValueError, np.linalg.LinAlgError) as error:
                    new = {"beta": None, "cov": None, "theta": None, "spread": None, "freedom": None, "gcv": None, "settled": True, "error": f"{type(error).__name__}: {error}"}
                out.append({k: r[k] for k in ("var", "lineage", "penalty", "low", "high")} | {"steps": int(r["steps"]) + 1} | new)
            if out:
                yield pd.DataFrame(out)[[c.split()[0] for c in COEFFICIENTS.split(", ")]]

    return table.mapInPandas(solve, COEFFICIENTS)


def fit(cells: DataFrame, distribution: str = "gamma", link: str = "log", n_knots: int = 6, penalty: float | list[float] = 0.6, expectile: float | None = None, natural: bool = False, max_steps: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """Coefficients of a smooth trend of each feature and lineage of cells (var, lineage, t, y, w), with an optional column `offset` on the scale of the predictor.

    Distributions are gaussian, poisson, gamma, inv_gauss, binomial and negative_binomial (log link; its size parameter, theta, is fitted beside the trend); links
    identity, log and logit. Of several penalties the one of least generalized cross-validation score is kept for each group, ties to the larger. An expectile other
    than the mean weighs residuals by their side. `natural` asks for second derivatives of 0 at the ends and penalizes the integral of the squared second derivative.

    Rows with a null or NaN in t, y or w take no part, a missing offset is 0. Repeated rows count as often as they are there. A group with a single time, one that
    diverges, or one that hasn't settled after max_steps has an error and no coefficients; an empty table gives an empty one. Other columns are left out.
    """
    if distribution not in _VARIANCES or link not in _LINKS:
        raise ValueError("unknown distribution or link")
    if n_knots < 3 if natural else n_knots < 2:
        raise ValueError("too few knots")
    negative = distribution == "negative_binomial"
    if negative and link != "log":
        raise ValueError("the negative binomial has a log link")
    penalties = [float(p) for p in (penalty if isinstance(penalty, (list, tuple)) else [penalty])]
    offset = F.coalesce(F.nanvl("offset", F.lit(0.0)), F.lit(0.0)) if "offset" in cells.columns else F.lit(0.0)
    numbers = [F.col(c).cast("double").alias(c) for c in ("t", "y", "w")]
    own = cells.select(F.col("var").cast("string").alias("var"), F.col("lineage").cast("string").alias("lineage"), *numbers, offset.cast("double").alias("o"))
    own = own.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("t", "y", "w")) + " AND var IS NOT NULL AND lineage IS NOT NULL")
    ends = cut(own.groupBy("var", "lineage").agg(F.min("t").alias("low"), F.max("t").alias("high")))
    small = ends.count() * len(penalties) <= BROADCAST_GROUPS
    rows = cut(_placed(own, ends, n_knots, small))
    each = ends.withColumn("penalty", F.explode(F.array(*[F.lit(p) for p in penalties])))
    lone = each.filter("NOT high > low").select(*KEYS, "low", "high", F.lit("ValueError: one time only").alias("error"))
    nothing = {name: F.lit(None).cast(kind) for name, kind in (c.split() for c in COEFFICIENTS.split(", "))}
    state = cut(each.filter("high > low").select(*[F.col(c) if c in (*KEYS, "low", "high") else v.alias(c) for c, v in (nothing | {"theta": F.lit(1.0), "steps": F.lit(0), "settled": F.lit(False)}).items()]))
    formulas = _formulas(distribution, link, expectile)
    done, waiting, left = [], state, state.count()
    for _ in range(max_steps):
        if not left:
            break
        known = waiting.select(*KEYS, "low", "high", "beta", "theta", "steps")
        new = cut(_stepped(_sums(rows, waiting, formulas, small).join(known, KEYS), n_knots, natural, negative, tolerance))
        release(waiting)
        waiting, before, left = new, left, new.filter("NOT settled").count()
        if left < before:
            done.append(new.filter("settled"))
            waiting = cut(new.filter("NOT settled"))
    release(rows)
    none_of = [c for c in nothing if c not in (*KEYS, "low", "high", "steps", "error")]
    late = waiting.withColumns({c: nothing[c] for c in none_of}).withColumn("error", F.lit(f"ValueError: not settled after {max_steps} steps"))
    out = late.select(*nothing)
    for part in (*done, lone.withColumns({c: nothing[c] for c in (*none_of, "steps")}).select(*nothing)):
        out = out.unionByName(part.select(*nothing))
    best = Window.partitionBy("var", "lineage").orderBy(F.col("gcv").asc_nulls_last(), F.desc("penalty"))
    return out.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "settled")


def predict(models: DataFrame, link: str = "log", n_points: int = 50, level: float = 0.95) -> DataFrame:
    """(var, lineage, t, y, low, high, error): each model on n_points even times between its ends, at an offset of 0. A model with an error has one row, the error."""
    width = NormalDist().inv_cdf(0.5 + level / 2)
    inverse = {"identity": lambda e: e, "log": lambda e: np.exp(np.clip(e, -30, 30)), "logit": lambda e: 1 / (1 + np.exp(-e))}[link]

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                same = {"var": r["var"], "lineage": r["lineage"]}
                if r["error"] is not None:
                    yield pd.DataFrame([same | {"t": None, "y": None, "low": None, "high": None, "error": r["error"]}])
                    continue
                beta, m = np.asarray(r["beta"]), len(r["beta"])
                grid = np.linspace(r["low"], r["high"], n_points)
                g = basis(grid, np.linspace(r["low"], r["high"], m - 2))
                half = width * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", g, np.asarray(r["cov"]).reshape(m, m), g) * r["spread"], 0))
                eta = g @ beta
                yield pd.DataFrame(same | {"t": grid, "y": inverse(eta), "low": inverse(eta - half), "high": inverse(eta + half), "error": None})

    kept = models.select("var", "lineage", "low", "high", "beta", "cov", "spread", "error")
    return kept.mapInPandas(drawn, "var string, lineage string, t double, y double, low double, high double, error string")


def predict_at(models: DataFrame, rows: DataFrame, link: str = "log") -> DataFrame:
    """Rows (var, lineage, t, ...) with `fitted`, the model's mean there: null without a model, for a null time, and of a model with an error; times beyond the ends count as the end."""
    own = models.select("var", "lineage", F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("beta").alias("_beta"))
    inner = F.size("_beta") - 3
    x = ratio(F.least(F.greatest(F.col("t"), F.col("_low")), F.col("_high")) - F.col("_low"), (F.col("_high") - F.col("_low")) / inner)
    s = F.least(F.floor(x), inner - 1).cast("int")
    joined = rows.join(own, ["var", "lineage"], "left").withColumn("_s", s).withColumn("_u", x - F.col("_s"))
    u = F.col("_u")
    values = ((1 - u) ** 3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6, (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, u**3 / 6)
    eta = sum((v * F.get("_beta", F.col("_s") + k) for k, v in enumerate(values)), F.lit(0.0))
    known = F.col("_beta").isNotNull() & F.col("t").isNotNull()
    return joined.withColumn("fitted", F.when(known, _LINKS[link][1](eta))).drop("_low", "_high", "_beta", "_s", "_u")


def residual_weights(models: DataFrame, rows: DataFrame, link: str = "log", cutoff: float = 3.0) -> DataFrame:
    """Cells (var, lineage, t, y, w, ...) weighed anew for a second fit: w times the bisquare of the residual over cutoff times its group's root mean square."""
    fitted = predict_at(models, rows, link).withColumn("_e", F.col("y") - F.col("fitted"))
    scale = fitted.groupBy("var", "lineage").agg(F.sqrt(ratio(F.sum(F.col("w") * F.col("_e") ** 2), F.sum("w"))).alias("_scale"))
    part = F.try_divide(F.col("_e"), F.col("_scale") * cutoff)
    joined = fitted.join(scale, ["var", "lineage"], "left")
    weight = F.when(part.isNull(), 1.0).when(F.abs(part) < 1, (1 - part**2) ** 2).otherwise(0.0)
    return joined.withColumn("w", F.col("w") * weight).drop("_e", "_scale", "fitted")
