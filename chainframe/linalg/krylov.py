"""Linear systems X = Q X + B over tables, by restarted GMRES.

A basis is a wide table: a row for each state, a column for each basis vector and right-hand side. A step is one join and sum (the
matrix times the newest vectors), two aggregates of dot products (Gram-Schmidt twice) and one write of the table; all right-hand sides go
in step, so one join serves them all. The driver holds a small Hessenberg matrix for each of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.lineage import cut, release
from chainframe.operators.matrix import apply_to


def _sum(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for x in parts:
        total = total + x
    return total


def _numbers(table: DataFrame, sums: list[Column]) -> list[float]:
    row = table.agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate(sums)]).first()
    return [float(x or 0.0) for x in row]


def _least(h: np.ndarray, beta: float) -> tuple[np.ndarray, float]:
    """y of least |beta e1 - H y|, and that size."""
    e = np.zeros(len(h))
    e[0] = beta
    y = np.linalg.lstsq(h, e, rcond=None)[0]
    return y, float(np.linalg.norm(e - h @ y))


def gmres(q: DataFrame, b: DataFrame, columns: list[str], tol: float = 1e-10, restart: int = 24, cycles: int = 60) -> DataFrame:
    """(i, columns...): X with X = Q X + B, until |B - (I - Q) X| <= tol |B| for each column; b lists all states.

    Rows are first divided by 1 - q_ii, which takes self-transitions out (a Jacobi preconditioner), so a chain that mostly stays where it is costs
    no more steps. The residual that ends it is computed anew from X and judged without that scaling, or is as small as rounding allows. A system that does
    not get there raises an error that states its residual.
    """
    names = {c: f"r{n}" for n, c in enumerate(columns)}  # short names: r right-hand side, x solution, v basis, w image
    rs = list(names.values())
    diagonal = q.filter("i = j").groupBy("i").agg(F.sum("w").alias("own"))
    base = b.select("i", *[F.col(c).cast("double").alias(n) for c, n in names.items()]).join(diagonal, "i", "left").withColumn("d", 1 - F.coalesce("own", F.lit(0.0))).drop("own")
    base = cut(base)
    if not base.filter("d <= 0").isEmpty():
        raise ValueError("a state is never left, so the system has no solution")
    moves = cut(q.filter("i <> j").join(base.select("i", "d"), "i").select("i", "j", (F.col("w") / F.col("d")).alias("w")))
    held = base.select("i", "d", *[(F.col(r) / F.col("d")).alias(r) for r in rs], *[F.lit(0.0).alias(f"x{r}") for r in rs])
    norms = dict(zip(rs, np.sqrt(_numbers(held, [(F.col(r) * F.col("d")) ** 2 for r in rs]))))

    def image(table: DataFrame, of: list[str], out: list[str]) -> DataFrame:
        moved = apply_to(moves, table.select("i", *of), of).select("i", *[F.col(x).alias(f"_{x}") for x in of])
        return table.join(moved, "i", "left").select(*table.columns, *[(F.col(x) - F.coalesce(f"_{x}", F.lit(0.0))).alias(y) for x, y in zip(of, out)])

    worst, kept = np.inf, None
    for cycle in range(cycles + 1):
        if cycle:
            held = image(held, [f"x{r}" for r in rs], [f"w{r}" for r in rs])
            held = held.select("i", "d", *rs, *[f"x{r}" for r in rs], *[(F.col(r) - F.col(f"w{r}")).alias(f"v0{r}") for r in rs])
        else:
            held = held.select("*", *[F.col(r).alias(f"v0{r}") for r in rs])
        held, old = cut(held), kept
        if old is not None:
            release(old)
        kept = held
        found = _numbers(held, [x for r in rs for x in (F.col(f"v0{r}") ** 2, (F.col(f"v0{r}") * F.col("d")) ** 2, (F.col(f"x{r}") * F.col("d")) ** 2)])
        beta, true, size = ({r: np.sqrt(found[3 * n + k]) for n, r in enumerate(rs)} for k in range(3))
        if all(true[r] <= max(tol * norms[r], 2e-15 * size[r]) for r in rs):
            return held.select("i", *[F.col(f"x{r}").alias(c) for c, r in names.items()])
        now = max(true[r] / norms[r] for r in rs if norms[r])
        if cycle == cycles or cycle > 8 and now > 0.999 * worst:
            raise RuntimeError(f"no convergence in {cycle} restarts: residual {now:.3g} of the right-hand side")
        worst = min(worst, now)
        live = [r for r in rs if true[r] > max(tol * norms[r], 2e-15 * size[r])]
        held = held.select("i", "d", *rs, *[f"x{r}" for r in rs], *[(F.col(f"v0{r}") / float(beta[r])).alias(f"v0{r}") for r in live])
        h = {r: np.zeros((restart + 1, restart)) for r in live}
        steps = 0
        for k in range(restart):
            held, old = cut(image(held, [f"v{k}{r}" for r in live], [f"w{r}" for r in live])), kept
            release(old)
            kept = held
            dots = _numbers(held, [F.col(f"v{n}{r}") * F.col(f"w{r}") for r in live for n in range(k + 1)])
            first = {r: dots[a * (k + 1) : (a + 1) * (k + 1)] for a, r in enumerate(live)}
            clear = held.select("*", *[(F.col(f"w{r}") - _sum([F.col(f"v{n}{r}") * first[r][n] for n in range(k + 1)])).alias(f"u{r}") for r in live])
            again = _numbers(clear, [F.col(f"v{n}{r}") * F.col(f"u{r}") for r in live for n in range(k + 1)] + [F.col(f"u{r}") ** 2 for r in live])
            new, small = [], 0
            for a, r in enumerate(live):
                second = again[a * (k + 1) : (a + 1) * (k + 1)]
                norm = np.sqrt(max(again[len(live) * (k + 1) + a] - sum(x * x for x in second), 0.0))
                h[r][: k + 1, k] = np.array(first[r]) + second
                end = norm <= 1e-14 * np.abs(h[r][: k + 1, k]).max(initial=1e-300)
                h[r][k + 1, k] = 0.0 if end else norm
                new.append((F.lit(0.0) if end else (F.col(f"u{r}") - _sum([F.col(f"v{n}{r}") * second[n] for n in range(k + 1)])) / float(norm)).alias(f"v{k + 1}{r}"))
                left = _least(h[r][: k + 2, : k + 1], beta[r])[1]
                small += end or left <= max(0.3 * tol * norms[r], 1e-15 * beta[r])
            held = clear.select("i", "d", *rs, *[f"x{r}" for r in rs], *[f"v{n}{r}" for n in range(k + 1) for r in live], *new)
            steps = k + 1
            if small == len(live):
                break
        more = {r: _least(h[r][: steps + 1, :steps], beta[r])[0] for r in live}
        held = held.select("i", "d", *rs, *[(F.col(f"x{r}") + (_sum([F.col(f"v{n}{r}") * float(more[r][n]) for n in range(steps)]) if r in more else F.lit(0.0))).alias(f"x{r}") for r in rs])
    raise AssertionError


def fixed_point(q: DataFrame, b: DataFrame, columns: list[str], steps: int | None = None, tol: float = 1e-10, every: int = 10, max_steps: int = 2_000) -> DataFrame:
    """The same by repetition: a given number of steps, or until what a step still adds is at most tol |B| for each column, which is the residual."""
    b, q = cut(b.select("i", *columns)), cut(q)
    size = np.sqrt(_numbers(b, [F.col(c).cast("double") ** 2 for c in columns]))
    x, done, kept = b, 0, None
    while True:
        moved = apply_to(q, x, columns).select("i", *[F.col(c).alias(f"_{c}") for c in columns])
        new = b.join(moved, "i", "left").select("i", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in columns])
        done += 1
        if done % every == 0:
            new = cut(new)
            if steps is None:
                both = new.join(x.select("i", *[F.col(c).alias(f"_{c}") for c in columns]), "i")
                left = np.sqrt(_numbers(both, [(F.col(c) - F.col(f"_{c}")) ** 2 for c in columns]))
                if (left <= tol * size).all():
                    return new
                if done >= max_steps:
                    raise RuntimeError(f"no convergence in {done} steps: residual {float(ratio_of(left, size)):.3g} of the right-hand side")
            if kept is not None:
                release(kept)
            kept = new
        x = new
        if steps is not None and done == steps:
            return x


def ratio_of(a: np.ndarray, b: np.ndarray) -> float:
    """The largest a / b, of those with b above 0."""
    return float(np.max(a[b > 0] / b[b > 0], initial=0.0))
