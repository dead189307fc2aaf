"""Small dense matrices on the driver: elimination without subtractions, real Schur forms in a wanted order."""

from __future__ import annotations

import numpy as np


def closed_classes(t: np.ndarray) -> list[np.ndarray]:
    """The recurrent classes of a small chain, as sorted indices."""
    reach = (t > 0) | np.eye(len(t), dtype=bool)
    while True:
        more = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (more == reach).all():
            break
        reach = more
    mutual = reach & reach.T
    out, seen = [], np.zeros(len(t), bool)
    for k in range(len(t)):
        if not seen[k]:
            seen |= mutual[k]
            if (reach[k] == mutual[k]).all():
                out.append(np.flatnonzero(mutual[k]))
    return out


def gth(t: np.ndarray) -> np.ndarray:
    """The stationary distribution of an irreducible chain, by state reduction: only sums, products and quotients of non-negative
    numbers, so each entry is right to rounding, however slow the chain mixes. The diagonal is never read."""
    a = np.array(t, float)
    n = len(a)
    for k in range(n - 1, 0, -1):
        a[:k, k] /= a[k, :k].sum()
        a[:k, :k] += np.outer(a[:k, k], a[k, :k])
    p = np.ones(n)
    for k in range(1, n):
        p[k] = p[:k] @ a[:k, k]
    return p / p.sum()


def absorbed(t: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """(states outside, ends): chances to end in each closed class from each state in none of them, by state reduction without subtractions."""
    inside = np.concatenate([*ends, np.zeros(0, int)]).astype(int)
    rest = np.setdiff1d(np.arange(len(t)), inside)
    n = len(rest)
    a = np.concatenate([t[np.ix_(rest, rest)], *[t[rest][:, e].sum(1, keepdims=True) for e in ends]], 1)
    out = lambda k: a[k, :k].sum() + a[k, n:].sum()
    for k in range(n - 1, -1, -1):
        a[k] /= out(k)
        a[:k, :k] += np.outer(a[:k, k], a[k, :k])
        a[:k, n:] += np.outer(a[:k, k], a[k, n:])
    for k in range(n):
        a[k, n:] += a[k, :k] @ a[:k, n:]
    return a[:, n:]


def stationary_from_uniform(t: np.ndarray) -> np.ndarray:
    """Where a walk from a uniformly drawn state is in the long run: each closed class's stationary distribution, by the chance to end in it."""
    ends = closed_classes(t)
    p = np.zeros(len(t))
    chance = absorbed(t, ends)
    for k, e in enumerate(ends):
        p[e] = gth(t[np.ix_(e, e)]) * (len(e) + chance[:, k].sum()) / len(t)
    return p / p.sum() if len(t) else p


def _rotate(t: np.ndarray, q: np.ndarray, k: int, size: int, turn: np.ndarray) -> None:
    at = slice(k, k + size)
    t[at] = turn.T @ t[at]
    t[:, at] = t[:, at] @ turn
    q[:, at] = q[:, at] @ turn


def real_schur(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, Q) with A = Q R Q', R upper quasi-triangular: 2 x 2 blocks on the diagonal only for conjugate pairs. Francis' double-shift iteration."""
    n = len(a)
    t, q = np.array(a, float), np.eye(n)
    for k in range(n - 2):  # to Hessenberg form
        x = t[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        if np.linalg.norm(x):
            x /= np.linalg.norm(x)
            t[k + 1 :] -= 2 * np.outer(x, x @ t[k + 1 :])
            t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ x, x)
            q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    t = np.triu(t, -1)
    high, stuck, scale = n - 1, 0, max(np.abs(t).max(initial=0.0), 1e-300)
    while high > 0:
        low = high
        while low > 0 and abs(t[low, low - 1]) > 1e-15 * (abs(t[low, low]) + abs(t[low - 1, low - 1]) or scale):
            low -= 1
        if low > 0:
            t[low, low - 1] = 0.0
        if low == high:
            high, stuck = high - 1, 0
            continue
        if low == high - 1:
            b = t[low : high + 1, low : high + 1]
            half = (b[0, 0] - b[1, 1]) / 2
            root = half * half + b[0, 1] * b[1, 0]
            if root >= 0:  # two real values: turned until triangular
                z = half + np.copysign(np.sqrt(root), half)
                v = np.array([z, b[1, 0]]) / np.hypot(z, b[1, 0]) if np.hypot(z, b[1, 0]) else np.array([1.0, 0.0])
                _rotate(t, q, low, 2, np.array([[v[0], -v[1]], [v[1], v[0]]]))
                t[high, low] = 0.0
            high, stuck = high - 2, 0
            continue
        stuck += 1
        if stuck > 200:
            raise RuntimeError("the Schur form did not settle")
        if stuck % 11 == 10:  # an exceptional shift
            total, product = 1.5 * abs(t[high, high - 1]), abs(t[high, high - 1]) ** 2
        else:
            total = t[high - 1, high - 1] + t[high, high]
            product = t[high - 1, high - 1] * t[high, high] - t[high - 1, high] * t[high, high - 1]
        x = np.array([t[low, low] ** 2 + t[low, low + 1] * t[low + 1, low] - total * t[low, low] + product, t[low + 1, low] * (t[low, low] + t[low + 1, low + 1] - total), t[low + 1, low] * t[low + 2, low + 1]])
        for k in range(low, high):
            m = min(3, high - k + 1)
            if k > low:
                x = t[k : k + m, k - 1].copy()
            x = x[:m].copy()
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            if np.linalg.norm(x):
                x /= np.linalg.norm(x)
                _rotate(t, q, k, m, np.eye(m) - 2 * np.outer(x, x))
            if k > low:
                t[k + 1 : k + m, k - 1] = 0.0
    return np.triu(t, -1), q


def blocks(r: np.ndarray) -> list[int]:
    """Sizes of the diagonal blocks."""
    out, k = [], 0
    while k < len(r):
        size = 2 if k + 1 < len(r) and r[k + 1, k] != 0 else 1
        out.append(size)
        k += size
    return out


def _swap(t: np.ndarray, q: np.ndarray, k: int, p: int, s: int) -> None:
    """Two neighbouring diagonal blocks, of sizes p and s from k on, change places."""
    a, b, c = t[k : k + p, k : k + p], t[k + p : k + p + s, k + p : k + p + s], t[k : k + p, k + p : k + p + s]
    x = np.linalg.solve(np.kron(a, np.eye(s)) - np.kron(np.eye(p), b.T), c.reshape(-1)).reshape(p, s)  # A X - X B = C
    turn = np.linalg.qr(np.concatenate([-x, np.eye(s)]), "complete")[0]
    _rotate(t, q, k, p + s, turn)
    t[k + s : k + s + p, k : k + s] = 0.0


def sorted_schur(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A real Schur form (R, Q) whose diagonal blocks stand by the real part of their eigenvalues, the largest first; no conjugate pair is split."""
    r, q = real_schur(a)
    value = lambda k, size: float(np.trace(r[k : k + size, k : k + size])) / size
    settled = False
    while not settled:
        settled, k = True, 0
        sizes = blocks(r)
        for n in range(len(sizes) - 1):
            p, s = sizes[n], sizes[n + 1]
            if value(k + p, s) > value(k, p) + 1e-13 * max(1.0, abs(value(k, p))):
                _swap(r, q, k, p, s)
                sizes[n], sizes[n + 1] = s, p
                settled = False
            k += sizes[n]
    return r, q
