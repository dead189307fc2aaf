"""Spectra, invariant subspaces, macrostates and coarse chains.

A basis is a wide table (i, x0, ..., xm-1), found by Krylov-Schur iteration to a residual; only
m x m matrices (Gram, Schur, coarse) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframe.lineage import cut
from chainframe.linalg.arnoldi import invariant, times
from chainframe.operators.matrix import apply_to


def _gram(a: DataFrame, left: list[str], right: list[str], weight: Column | None = None) -> np.ndarray:
    """Sums over rows of products of columns: one aggregate."""
    w = weight if weight is not None else F.lit(1.0)
    row = a.agg(*[F.sum(w * F.col(p) * F.col(q)).alias(f"g{k}_{n}") for k, p in enumerate(left) for n, q in enumerate(right)]).first()
    return np.array(list(row), float).reshape(len(left), len(right))


def invariant_subspace(edges: DataFrame, m: int, restarts: int = 200, tol: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """An orthonormal basis (i, x0, ...) of the m leading Schur vectors and their m x m matrix, a real Schur form sorted by real parts (one more if m would split a conjugate pair).

    The residual |T X - X R| is at most tol, or an error is raised.
    """
    basis, ritz, _ = invariant(edges, m, tol, restarts)
    return basis, ritz


def eigenvalues(ritz: np.ndarray) -> np.ndarray:
    """Largest real part first."""
    values = np.linalg.eigvals(ritz)
    return values[np.argsort(-values.real, kind="stable")]


def eigengap(values: np.ndarray, alpha: float = 1.0) -> int:
    """Index of the largest gap between successive real parts, less alpha times the distance of the upper one from 1."""
    real = np.sort(np.real(values))[::-1]
    gaps = real[:-1] - real[1:] - alpha * (1 - real[:-1])
    return int(np.argmax(gaps)) if len(gaps) else 0


def memberships(basis: DataFrame, m: int, clip: bool = True) -> DataFrame:
    """(i, m0, ..., mm-1), non-negative with row sums 1, by the inner simplex of the basis.

    The m most extreme rows are found one after another by one aggregate each; they become the corners.
    """
    names, out = [f"x{k}" for k in range(m)], [f"m{k}" for k in range(m)]
    corners: list[np.ndarray] = []

    def farthest(transform: np.ndarray, shift: np.ndarray) -> np.ndarray:
        total = F.lit(0.0)
        for k in range(m):
            part = F.lit(0.0)
            for n, name in enumerate(names):
                part = part + (F.col(name) - float(shift[n])) * float(transform[n, k])
            total = total + part * part
        row = basis.select("i", *names, total.alias("d")).agg(F.max_by(F.struct(*names), F.struct("d", "i")).alias("top")).first()["top"]
        return np.array([row[n] for n in names])

    corners.append(farthest(np.eye(m), np.zeros(m)))
    directions = np.zeros((0, m))
    for _ in range(m - 1):
        project = np.eye(m) - (directions.T @ np.linalg.pinv(directions.T) if len(directions) else 0)
        corners.append(farthest(project, corners[0]))
        directions = np.stack([c - corners[0] for c in corners[1:]])
    chi = times(basis, names, np.linalg.pinv(np.stack(corners)), out)
    if not clip:
        return chi
    chi = chi.select("i", *[F.greatest(F.col(n), F.lit(0.0)).alias(n) for n in out])
    total = F.lit(0.0)
    for n in out:
        total = total + F.col(n)
    return chi.select("i", *[(F.col(n) / total).alias(n) for n in out])


def _crispness(alpha: np.ndarray, points: np.ndarray, m: int) -> tuple[float, np.ndarray]:
    """How crisp memberships X A are, and A, for the inner (m-1) x (m-1) part of A: the rest makes rows sum to 1 and the least membership of the points 0.

    X has a constant first column 1 and is orthonormal over all rows, so the measure is the sum over j of |A_j|^2 / A_0j, at most m.
    """
    a = np.zeros((m, m))
    a[1:, 1:] = alpha.reshape(m - 1, m - 1)
    a[1:, 0] = -a[1:, 1:].sum(1)
    a[0] = -(points[:, 1:] @ a[1:]).min(0)
    if a[0].min() <= 1e-12:
        return -np.inf, a
    a /= a[0].sum()
    return float(((a * a).sum(0) / a[0]).sum()), a


def _climb(f, start: np.ndarray, steps: int) -> np.ndarray:
    """A simplex search for a maximum of few variables: reflect, stretch, contract or shrink."""
    n = len(start)
    corners = [start, *(start + np.eye(n)[k] * (0.1 * abs(start[k]) + 0.01) for k in range(n))]
    held = sorted(((f(x), k, x) for k, x in enumerate(corners)), key=lambda y: (-y[0], y[1]))
    for step in range(steps):
        best, worst = held[0], held[-1]
        if abs(best[0] - worst[0]) <= 1e-10:
            break
        middle = np.mean([x for _, _, x in held[:-1]], 0)
        tries = [(f(x), n + 1 + step, x) for x in (2 * middle - worst[2],)]
        if tries[0][0] > best[0]:
            tries.append((f(3 * middle - 2 * worst[2]), n + 1 + step, 3 * middle - 2 * worst[2]))
        elif tries[0][0] <= held[-2][0]:
            tries.append((f((middle + worst[2]) / 2), n + 1 + step, (middle + worst[2]) / 2))
        new = max(tries, key=lambda y: y[0])
        if new[0] > worst[0]:
            held[-1] = new
        else:
            held = [held[0], *((f(x), k, x) for _, k, x in ((v, k, (best[2] + x) / 2) for v, k, x in held[1:]))]
        held.sort(key=lambda y: (-y[0], y[1]))
    return held[0][2]


def optimized_memberships(basis: DataFrame, m: int, steps: int = 2_000, rounds: int = 200) -> tuple[DataFrame, float]:
    """(i, m0, ..., mm-1) of greatest crispness, non-negative with row sums 1, and the crispness over m.

    Starts at the inner simplex of the basis. Which rows bound the memberships is found as it goes: the m x m transform is optimized over the outermost rows
    known, one aggregate finds each column's least row under it, and these join the known ones until none is new.
    """
    names, out = [f"x{k}" for k in range(m)], [f"m{k}" for k in range(m)]
    if m == 1:
        return basis.select("i", F.lit(1.0).alias("m0")), 1.0
    n = basis.count()
    # an orthonormal basis whose first column is constant, times the root of n
    constant = np.array([r for r in basis.agg(*[F.sum(x) for x in names]).first()], float)
    turn, _ = np.linalg.qr(np.column_stack([constant, np.eye(m)[:, 1:]]))
    turn = turn * np.sqrt(n) * np.append(np.sign(constant @ turn[:, 0]) or 1.0, np.ones(m - 1))
    scaled = cut(times(basis, names, turn, names))

    def least(directions: np.ndarray) -> list[np.ndarray]:
        """The row of least value in each direction (a column)."""
        def value(k: int) -> Column:
            total = F.lit(0.0)
            for d, x in zip(directions[:, k].tolist(), names):
                total = total + F.col(x) * float(d)
            return total

        row = scaled.agg(*[F.min_by(F.array(*names), F.struct(value(k), "i")).alias(f"r{k}") for k in range(directions.shape[1])]).first()
        return [np.array(row[k], float) for k in range(directions.shape[1])]

    around = np.concatenate([np.zeros((1, 2 * m * m)), np.random.default_rng(0).standard_normal((m - 1, 2 * m * m))])
    points = np.unique(np.round(np.stack([*least(around), *least(np.eye(m)), *least(-np.eye(m))]), 12), axis=0)
    chosen = [int(np.argmax((points**2).sum(1)))]
    for _ in range(m - 1):  # corners: the farthest from those chosen
        span = (points[chosen[1:]] - points[chosen[0]]).T
        free = points - points[chosen[0]]
        free = free - free @ (span @ np.linalg.pinv(span)) if len(chosen) > 1 else free
        chosen.append(int(np.argmax((free**2).sum(1))))
    alpha = np.linalg.pinv(points[chosen])[1:, 1:].reshape(-1)
    for _ in range(rounds):
        alpha = _climb(lambda x: _crispness(x, points, m)[0], alpha, steps)
        crisp, a = _crispness(alpha, points, m)
        more = np.unique(np.round(np.stack(least(a)), 12), axis=0)
        more = more[(more @ a).min(1) < -1e-9]
        if not len(more):
            break
        points = np.concatenate([points, more])
    else:
        raise RuntimeError(f"{len(more)} rows still bound the memberships after {rounds} rounds")
    chi = times(scaled, names, a, out)
    chi = chi.select("i", *[F.greatest(F.col(x), F.lit(0.0)).alias(x) for x in out])
    total = F.lit(0.0)
    for x in out:
        total = total + F.col(x)
    return chi.select("i", *[(F.col(x) / total).alias(x) for x in out]), crisp / m


def coarse_chain(edges: DataFrame, chi: DataFrame, names: list[str]) -> np.ndarray:
    """The chain between memberships, (chi' chi)^-1 chi' T chi."""
    moved = apply_to(edges, chi, names).select("i", *[F.col(n).alias(f"y{n}") for n in names])
    return np.linalg.solve(_gram(chi, names, names), _gram(chi.join(moved, "i"), names, [f"y{n}" for n in names]))


def splits_pair(values: np.ndarray, n: int) -> bool:
    """Whether the n leading eigenvalues hold one of two conjugate ones but not the other."""
    return n < len(values) and abs(values[n - 1].imag) > 1e-9 and abs(values[n - 1] - np.conj(values[n])) <= 1e-9


def states_of(values: np.ndarray, n: int | tuple[int, int] | None, basis: DataFrame | None = None) -> int:
    """How many macrostates: a number (one more if it would split a conjugate pair), the eigengap's, or of an interval that of the largest least inner-simplex membership.

    The least membership over all rows is at most 0, and 0 if the simplex is exact.
    """
    if n is None:
        n = eigengap(values) + 1
    if isinstance(n, tuple):
        low, high = n
        if not 1 < low <= high:
            raise ValueError("an interval begins above 1")
        tried = [k for k in range(low, high + 1) if not splits_pair(values, k)]
        if not tried:
            raise ValueError("each number would split a conjugate pair")
        return max(tried, key=lambda k: (round(least_membership(basis, k), 9), k))
    return n + 1 if splits_pair(values, n) else n


def least_membership(basis: DataFrame, m: int) -> float:
    """The least entry of the inner-simplex memberships of the first m columns, before negative ones are cut off."""
    raw = memberships(basis, m, clip=False)
    return float(raw.agg(F.least(*[F.min(f"m{k}") for k in range(m)]) if m > 1 else F.min("m0")).first()[0])


def macrostates(edges: DataFrame, m: int, restarts: int = 200, method: str = "simplex") -> tuple[DataFrame, list[str], np.ndarray]:
    """Memberships, their column names and the coarse chain of m macrostates (one more if m would split a conjugate pair); one macrostate is membership 1 everywhere.

    method: "simplex" takes the inner simplex as it is, "crisp" optimizes it.
    """
    basis, ritz = invariant_subspace(edges, m, restarts)
    m = len(ritz)
    names = [f"m{k}" for k in range(m)]
    chi = cut(optimized_memberships(basis, m)[0] if method == "crisp" else memberships(basis, m))
    return chi, names, coarse_chain(edges, chi, names)


def coarse_order(names: list[str], coarse: np.ndarray, by: str = "stability") -> list[str]:
    """Macrostates by self-transition, incoming or outgoing probability or stationary share, the largest first."""
    if by == "stability":
        value = np.diag(coarse)
    elif by in ("incoming", "outgoing"):
        value = coarse.sum(0 if by == "incoming" else 1) - np.diag(coarse)
    elif by == "stat_dist":
        value = coarse_stationary(coarse)
    else:
        raise ValueError("by is stability, incoming, outgoing or stat_dist")
    return [names[k] for k in np.argsort(-value, kind="stable")]


def coarse_stationary(coarse: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(coarse.T)
    p = np.abs(np.real(vectors[:, np.argmax(values.real)]))
    return p / p.sum()


def identification(found: dict[int, list[str] | None], wanted: list[str]) -> list[tuple[int, int, int]]:
    """(number of macrostates, wanted states identified, how many could be) from the names found with each number; None is a failed computation.

    Names count up to their first underscore. A failed number takes the count of the next lower one, 0 below all.
    """
    out, last = [], 0
    for n in sorted(found):
        if found[n] is not None:
            last = len({name.split("_")[0] for name in found[n]} & set(wanted))
        out.append((n, last, min(n, len(wanted))))
    return out


def identification_score(table: list[tuple[int, int, int]]) -> float:
    """The sum of identified over the sum of identifiable states."""
    return sum(x[1] for x in table) / sum(x[2] for x in table)


def terminal_state_index(edges: DataFrame, cells: DataFrame, column: str, wanted: list[str], most: int, n_cells: int = 30, restarts: int = 200) -> tuple[float, list[tuple[int, int, int]]]:
    """How well 1 to `most` macrostates, named after labels of cells (obs, column), find the wanted labels: score and `identification`."""
    from chainframe.operators.states import from_memberships, named

    found: dict[int, list[str] | None] = {}
    for n in range(1, most + 1):
        try:
            chi, names, _ = macrostates(edges, n, restarts)
            found[n] = [r["state"] for r in named(from_memberships(chi, names, n_cells), cells, column).select("state").distinct().collect()]
        except ValueError:  # a macrostate with too few cells
            found[n] = None
    table = identification(found, wanted)
    return identification_score(table), table


def terminal(names: list[str], coarse: np.ndarray, method: str = "stability", threshold: float = 0.96, n: int | None = None) -> list[str]:
    """Macrostates that are terminal: self-transition of at least the threshold, or the n most stable ones."""
    stability = np.diag(coarse)
    if method == "stability":
        return [x for x, s in zip(names, stability) if s >= threshold]
    if method == "top_n" and n:
        return [names[k] for k in np.argsort(-stability, kind="stable")[:n]]
    if method in ("eigengap", "eigengap_coarse"):
        n = eigengap(eigenvalues(coarse)) + (method == "eigengap")
        if not n:
            raise ValueError("the eigengap leaves no state")
        return [names[k] for k in np.argsort(-stability, kind="stable")[:n]]
    raise ValueError("method is stability, top_n (with n), eigengap or eigengap_coarse")


def initial(names: list[str], coarse: np.ndarray, n: int = 1) -> list[str]:
    """The n macrostates of least coarse stationary probability."""
    return [names[k] for k in np.argsort(coarse_stationary(coarse), kind="stable")[:n]]
