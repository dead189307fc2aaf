"""Leading invariant subspaces of a matrix given as an edge table, by block Arnoldi steps with Krylov-Schur restarts.

A basis is a wide table (i, x0, x1, ...), in packets while it grows. A step is one product for a block of columns with one write, and one or two sums of dot
products (Gram-Schmidt twice, where the first took much away); only the small projected matrix is on the driver. A restart keeps the leading part of its sorted real
Schur form, which turns the basis, and goes on from the block that was next; what has converged is locked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainframe.lineage import cut, release
from chainframe.linalg.dense import blocks, sorted_schur
from chainframe.linalg.packets import dealt, dots, gram, matrix, packed, turned, unpacked, with_columns, with_product

#: States up to which the driver takes the whole matrix, and columns of a block.
DENSE, BLOCK = 1_000, 3


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch[name].to_numpy(zero_copy_only=False) for name in names], 1)


def times(a: DataFrame, names: list[str], by: np.ndarray, out: list[str]) -> DataFrame:
    """The wide table times a small matrix, batch by batch."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, names) @ by
            yield pa.RecordBatch.from_arrays([batch["i"], *map(pa.array, x.T)], ["i", *out])

    kind = a.schema["i"].dataType.simpleString()
    return a.select("i", *names).mapInArrow(turned, f"i {kind}, " + ", ".join(f"{x} double" for x in out))


def _whole(r: np.ndarray, k: int) -> int:
    """k, or one more if k would split a pair of eigenvalues."""
    return k + 1 if k < len(r) and r[k, k - 1] != 0 else k


def _leading(t: np.ndarray, k: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(R, X): the k leading Schur vectors of a small matrix (one more if k would split a pair), from its eigenvectors, or where these are too
    near to each other for the residual, from its whole Schur form."""
    values, vectors = eigenpairs(t)
    wide = min(k + 1, len(t)) if k < len(t) and values[k - 1].imag > 1e-12 else k
    parts = np.stack([vectors[:, c].imag if values[c].imag < 0 else vectors[:, c].real for c in range(wide)], 1)
    x = np.linalg.qr(parts)[0]
    r, turn = sorted_schur(x.T @ t @ x)
    x = x @ turn
    if np.linalg.norm(t @ x - x @ r) <= tol * max(1.0, np.linalg.norm(r, 2)):
        return r, x
    r, q = sorted_schur(t)
    k = _whole(r, k)
    return r[:k, :k], q[:, :k]


def invariant(edges: DataFrame, k: int, tol: float = 1e-9, restarts: int = 200, seed: int = 0, columns: int | None = None) -> tuple[DataFrame, np.ndarray, float]:
    """(basis, R, residual): an orthonormal basis of the k leading Schur vectors (largest real part first), T X = X R with R quasi-triangular, and |T X - X R|.

    k grows by one if it would split a conjugate pair. It ends when the residual is at most tol (relative to R, if that is larger than 1), else an error states
    the residual. Eigenvalues that occur several times are found as often as blocks and further random starts show them.
    """
    edges = cut(edges.select("i", "j", "w"))
    ids = cut(edges.select("i").union(edges.select("j")).distinct())
    n = ids.count()
    if not 1 <= k <= n:
        raise ValueError(f"{k} vectors of {n} states")
    if n <= DENSE:
        at = {x: a for a, x in enumerate(sorted(r["i"] for r in ids.collect()))}
        t = np.zeros((n, n))
        for i, j, w in edges.collect():
            t[at[i], at[j]] += w
        r, q = _leading(t, k, tol)
        k = len(r)
        kind = ids.schema["i"].dataType.simpleString()
        rows = [(x, *map(float, q[a])) for x, a in at.items()]
        return edges.sparkSession.createDataFrame(rows, f"i {kind}, " + ", ".join(f"x{c} double" for c in range(k))), r, float(np.linalg.norm(t @ q - q @ r))
    most = min(columns or max(2 * k + 8 * BLOCK, 30), n)
    places, tasks = dealt(ids, n)
    entries = cut(matrix(edges, places, tasks))
    release(edges)
    release(ids)

    def noise(a: int, fresh: range) -> DataFrame:
        """Columns of numbers by a hash of the id."""
        number = lambda b: ((F.pmod(F.xxhash64(F.lit(seed), F.lit(a), F.lit(b), "i"), F.lit(1_000_003)) / 1_000_003.0) - 0.5)
        one = lambda b: F.lit(1.0) if (a, b) == (0, 0) else number(b)
        return packed(places.select("b", "p", *[one(b).alias(f"s{b}") for b in fresh]), [f"s{b}" for b in fresh], tasks)

    def orthonormal(table: DataFrame, done: int, fresh: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """(table, turn, H): table times turn has the done columns, and the fresh ones made orthonormal and orthogonal to them; H is what they were, table = (table turn) H."""
        one, every = np.eye(done + fresh), gram(table, done + fresh)
        first, second = every[:done, done:], np.zeros((done, fresh))
        clear, rest = one.copy(), every[done:, done:] - first.T @ first
        clear[:done, done:] = -first
        if np.linalg.eigvalsh(rest).min() < 0.01 * np.trace(every[done:, done:]):  # again, as it took much away
            both = dots(table, clear, clear[:, done:])
            second, rest = both[:done], both[done:] - both[:done].T @ both[:done]
        size, turn = np.linalg.eigh((rest + rest.T) / 2)
        scale = max(float(np.trace(rest) + (first**2).sum()), 1e-300)
        good = size > 1e-20 * scale
        root = np.sqrt(size[good])
        by = np.concatenate([-second @ turn[:, good] / root, turn[:, good] / root])
        whole = np.concatenate([one[:, :done], clear @ by], 1)
        h = np.concatenate([first + second, (turn[:, good] * root).T])
        if good.any() and root.min() < 1e-5 * root.max():  # once more, as the block was nearly dependent
            old, table, one = table, cut(turned(table, whole)), np.eye(done + len(root))
            release(old)
            again = gram(table, done + len(root))[:, done:]
            off, rest = again[:done], again[done:]
            half = np.linalg.cholesky(rest - off.T @ off).T
            by = np.linalg.inv(half)
            whole = np.concatenate([one[:, :done], np.concatenate([-off @ by, by])], 1)
            h = np.concatenate([h[:done] + off @ h[done:], half @ h[done:]])
        return table, whole, h

    # the basis is table times turn: a step writes its table once, and restarts only change the turn
    table, turn, h0 = orthonormal(cut(noise(0, range(BLOCK))), 0, BLOCK)
    have, spread, h = h0.shape[0], 0, np.zeros((h0.shape[0], 0))  # columns, those of them multiplied, and the projection

    def grow(more: DataFrame, fresh: int) -> np.ndarray:
        nonlocal table, turn, have
        old = table
        table, turn, h0 = orthonormal(cut(more), have, fresh)
        release(old)
        have = h0.shape[0]
        return h0

    for restart in range(restarts):
        while spread < most and spread < have:
            fresh, before = have - spread, have
            more = grow(with_product(table, turn, entries, fresh, tasks), fresh)
            grown = np.zeros((have, spread + fresh))
            grown[:before, :spread], grown[:, spread:] = h, more
            h, spread = grown, before
            if have == spread < min(most, n):  # invariant already: a further start finds what it misses
                fresh = min(BLOCK, n - have)
                grow(with_columns(table, turn, noise(restart + 1, range(have, have + fresh)), fresh, tasks), fresh)
                h = np.concatenate([h, np.zeros((have - spread, spread))])
        r, q = sorted_schur(h[:spread, :spread])
        tail = h[spread:, :] @ q
        tail[:, np.linalg.norm(tail, axis=0) < 1e-15] = 0.0  # locked
        wanted = _whole(r, min(k, spread))
        left = float(np.linalg.norm(tail[:, :wanted]))
        if left <= tol * max(1.0, np.linalg.norm(r[:wanted, :wanted], 2)):
            basis = cut(unpacked(turned(table, turn[:, :spread] @ q[:, :wanted]), [f"x{c}" for c in range(wanted)], places))
            for x in (table, entries, places):
                release(x)
            return basis, r[:wanted, :wanted], left
        keep = _whole(r, min(wanted + max((spread - wanted) // 3, 1), spread - 1))
        turn = np.concatenate([turn[:, :spread] @ q[:, :keep], turn[:, spread:]], 1)
        h, spread, have = np.concatenate([r[:keep, :keep], tail[:, :keep]]), keep, keep + have - spread
    raise RuntimeError(f"no convergence in {restarts} restarts: residual {left:.3g}")


def eigenpairs(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a sorted quasi-triangular matrix in its order, of a pair the one with positive imaginary part first, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eig(r)
    order = sorted(range(len(r)), key=lambda a: (-round(values[a].real, 12), -values[a].imag))
    return values[order], vectors[:, order]


__all__ = ["blocks", "eigenpairs", "invariant", "times"]
