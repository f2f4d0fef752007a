"""Singular values and right singular vectors of a small square matrix, to high relative accuracy.

Householder reflections make the matrix bidiagonal, differential quotient-difference steps with shifts
(dqds) find the singular values, and twisted factorisations of the shifted normal matrix, which are
computed by differential recurrences as well, give the vectors. The matrix has the number of
dimensions as its side, never the number of rows, so this runs wherever the matrix is.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny
#: Singular values closer than this, relatively, have their vectors made orthogonal to each other.
CLUSTER = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit ``v`` and ``alpha`` with ``(I - 2 v v') x = alpha e1``."""
    v = x.copy()
    size = np.linalg.norm(x)
    if size == 0:
        return np.zeros_like(v), 0.0
    alpha = -np.copysign(size, x[0])
    v[0] -= alpha
    return v / np.linalg.norm(v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diag, above, w`` with ``r = u @ bidiagonal(diag, above) @ w.T`` for some orthogonal u."""
    a = np.array(r, float)
    d = a.shape[1]
    w = np.eye(d)
    for k in range(d):
        v, a[k, k] = _reflector(a[k:, k])
        a[k + 1 :, k] = 0
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k + 2 < d:
            v, a[k, k + 1] = _reflector(a[k, k + 1 :])
            a[k, k + 2 :] = 0
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One step of L U -> U L - shift; None if the shift was above the smallest value."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    smallest = d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if shift == 0:
            new_q[i] = max(new_q[i], _TINY)
        elif d < 0 or new_q[i] <= 0:
            return None
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        smallest = min(smallest, d)
    new_q[n - 1] = d
    return None if d < 0 and shift else (new_q, new_e, smallest)


def squared_singular_values(diag: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B' B`` for bidiagonal B, falling."""
    found, blocks = [], []
    start = 0
    scale = max(np.abs(diag).max(initial=0), np.abs(above).max(initial=0))
    for i in range(len(diag)):
        if i == len(diag) - 1 or abs(above[i]) <= EPS * EPS * scale:
            blocks.append((diag[start : i + 1], above[start:i]))
            start = i + 1
    for d, a in blocks:
        found.extend(_block_values(d, a))
    return np.sort(np.array(found))[::-1]


def _block_values(diag: np.ndarray, above: np.ndarray) -> list[float]:
    q, e, total, found = list(map(float, diag**2)), list(map(float, above**2)), 0.0, []
    shift, steps = 0.0, 0
    while q:
        n = len(q)
        if n == 1:
            found.append(q.pop() + total)
            break
        # deflate at the bottom, or where a coupling is lost against what surrounds it
        if e[-1] <= EPS * EPS * (total + q[-1]):
            found.append(q.pop() + total)
            e.pop()
            shift = 0.0
            continue
        if n == 2:
            both = q[0] + q[1] + e[0]
            # roots of x^2 - both x + q0 q1, the larger one without cancellation
            half = both / 2
            root = np.sqrt(max(half * half - q[0] * q[1], 0.0))
            large = half + root
            found += [large + total, (q[0] * q[1] / large if large else 0.0) + total]
            break
        steps += 1
        if steps > 100 * len(diag):
            raise ArithmeticError("the singular values did not converge")
        step = _dqds(q, e, shift)
        while step is None:  # without a shift a step always succeeds
            shift = shift / 4 if shift > EPS * max(total, q[-1]) else 0.0
            step = _dqds(q, e, shift)
        q, e, smallest = step
        total += shift
        # the smallest of the quotients bounds the smallest value from above; stay below it
        shift = max(0.0, 0.98 * (min(smallest, q[-1]) - np.sqrt(e[-1] * q[-1]))) if len(q) > 1 else 0.0
    return found


def _twisted(diag: np.ndarray, above: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the stationary and progressive factorisations of ``B'B - lam`` and all twists.

    ``B'B`` is ``L D L'`` with ``D = diag**2`` and ``L = above / diag`` below its diagonal.
    """
    n = len(diag)
    tiny = EPS * EPS * max(lam, _TINY / EPS**3)
    dd, ll = diag**2, np.divide(above, diag[:-1], out=np.zeros(n - 1), where=diag[:-1] != 0)
    lower, upper = np.zeros(n - 1), np.zeros(n - 1)
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -lam
    for i in range(n - 1):
        plus = s[i] + dd[i]
        plus = plus if abs(plus) > tiny else -tiny
        lower[i] = dd[i] * ll[i] / plus
        s[i + 1] = lower[i] * ll[i] * s[i] - lam
    p[n - 1] = dd[n - 1] - lam
    for i in range(n - 2, -1, -1):
        minus = dd[i] * ll[i] * ll[i] + p[i + 1]
        minus = minus if abs(minus) > tiny else -tiny
        ratio = dd[i] / minus
        upper[i] = ll[i] * ratio
        p[i] = p[i + 1] * ratio - lam
    return lower, upper, s + p + lam


def _vector(diag: np.ndarray, above: np.ndarray, lam: float, against: list[np.ndarray]) -> np.ndarray:
    """Unit eigenvector of ``B'B`` for ``lam``, orthogonal to those of the same cluster."""
    n = len(diag)
    if n == 1:
        return np.ones(1)
    lower, upper, gamma = _twisted(diag, above, lam)
    best = None
    for r in np.argsort(np.abs(gamma)):
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -upper[i] * z[i]
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in against:
                z -= (other @ z) * other
        size = np.linalg.norm(z)
        if best is None or size > best[0]:
            best = size, z / size if size else z
        if size > 0.5:  # else another twist, whose vector lies less in the span of its cluster
            break
    return best[1]


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values, vectors``: squared singular values, falling, and the right singular vectors as columns."""
    diag, above, w = bidiagonalise(r)
    n = len(diag)
    scale = max(np.abs(diag).max(initial=0), np.abs(above).max(initial=0))
    cut = [i for i in range(n - 1) if abs(above[i]) <= EPS * scale]
    values, vectors = [], []
    for start, end in zip([0, *(c + 1 for c in cut)], [*(c + 1 for c in cut), n]):
        d, a = diag[start:end].copy(), above[start : end - 1]
        d[d == 0] = EPS * EPS * scale or 1.0
        near: list[np.ndarray] = []
        last = None
        for lam in squared_singular_values(diag[start:end], a):
            if last is not None and last - lam > CLUSTER * last:
                near = []
            z = _vector(d, a, lam, near)
            near.append(z)
            last = lam
            full = np.zeros(n)
            full[start:end] = z
            values.append(lam)
            vectors.append(full)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], w @ np.array(vectors)[order].T
