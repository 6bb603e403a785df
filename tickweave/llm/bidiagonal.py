"""Singular values and right singular vectors of a triangular factor.

Householder reflections make it bidiagonal; dqds finds the squared singular
values to high relative accuracy; twisted factorisations give the vectors.
All arrays are d x d for vectors of d entries, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V^T for an upper bidiagonal B."""
    a = np.array(r, np.float64)
    d = a.shape[1]
    v = np.eye(d)
    for k in range(d):
        u = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(u, 2 * (u @ a[k:, k:]))
        if k < d - 2:
            w = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(2 * (a[k:, k + 1 :] @ w), w)
            v[:, k + 1 :] -= np.outer(2 * (v[:, k + 1 :] @ w), w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector whose reflection takes x to a multiple of the first axis; 0 for x = 0."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0:
        return np.zeros_like(x)
    u = x / scale
    u[0] += np.copysign(np.linalg.norm(u), u[0])
    return u / np.linalg.norm(u)


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One differential qd transform: (q, e, last d, whether all d before the last are positive)."""
    n = len(q)
    q_new, e_new = np.empty(n), np.empty(n - 1)
    d = float(q[0]) - shift
    for i in range(n - 1):
        if not d > 0:
            return q_new, e_new, d, False
        top = d + e[i]
        ratio = q[i + 1] / top
        q_new[i], e_new[i] = top, e[i] * ratio
        d = d * ratio - shift
    q_new[-1] = d
    return q_new, e_new, d, True


def _least_bound(q: np.ndarray, e: np.ndarray) -> float:
    """Below the least eigenvalue: the inverse trace of the inverse, by an unshifted transform."""
    d, total = float(q[0]), 1 / float(q[0])
    for i in range(len(e)):
        d = d * q[i + 1] / (d + e[i])
        if d == 0:
            return 0.0
        total += 1 / d
    return (1 - 16 * len(q) * EPS) / total


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix without zeros, falling."""
    q, e = np.asarray(diagonal, np.float64) ** 2, np.asarray(above, np.float64) ** 2
    total, found = 0.0, []
    for _ in range(200 * len(q) + 200):
        if len(q) == 0:
            return np.sort(np.array(found))[::-1]
        if len(q) == 1 or e[-1] <= (EPS * 10) ** 2 * (total + q[-1]):
            found.append(total + q[-1])
            q, e = q[:-1], e[: max(0, len(q) - 2)]
            continue
        if e[0] <= (EPS * 10) ** 2 * (total + q[0]) and len(q) > 1:
            found.append(total + q[0])
            q, e = q[1:], e[1:]
            continue
        if q[0] < q[-1]:  # graded the other way: the transform converges at the lower end
            q, e = _turned(q, e)
        shift = min(float(q[-1]), float(q.min()))
        done = None
        for attempt in range(4):
            q_new, e_new, d, early = _qd_step(q, e, shift)
            if early and d >= 0:
                done = q_new, e_new, shift
                break
            if early and attempt < 2 and shift + d > 0:
                shift = (shift + d) * (1 - 4 * EPS)  # failed at the last entry alone: a close lower bound
            else:
                shift = _least_bound(q, e) if attempt < 3 else 0.0
        if done is None:
            q_new, e_new, d, _ = _qd_step(q, e, 0.0)
            done = q_new, e_new, 0.0
        q, e = done[0], done[1]
        total += done[2]
        if q[-1] == 0:
            e[-1] = 0.0
    raise ArithmeticError("dqds did not converge")


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The qd array of the same eigenvalues from the lower end upwards."""
    return q[::-1].copy(), e[::-1].copy()


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """(unit vector, corrected value) of B^T B for an eigenvalue, from the twisted factorisation of least pivot.

    L D L^T = B^T B; L D L^T - value is factored from the top (stationary qd)
    and from the bottom (progressive qd), the two meet at the twist.
    """
    n = len(diagonal)
    big, low = diagonal**2, above / diagonal[:-1]
    tiny = max(EPS * EPS * float(big.max()), np.finfo(np.float64).tiny * 4)
    plus, s = np.empty(max(0, n - 1)), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + big[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        plus[i] = big[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    minus, p = np.empty(max(0, n - 1)), np.empty(n)
    p[-1] = big[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = big[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        ratio = big[i] / pivot
        minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    pivots = s + p + value
    twist = int(np.argmin(np.abs(pivots)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -minus[i] * z[i]
    length = float(np.linalg.norm(z))
    return z / length, value + float(pivots[twist]) / length**2


def _block_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: unit eigenvectors of an unreduced block for its falling values, orthogonal also inside clusters."""
    t = np.diag(diagonal**2) + np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    t[np.arange(1, len(t)), np.arange(1, len(t))] += above**2
    out = np.zeros((len(diagonal), len(values)))
    for j, value in enumerate(values):
        z, better = twisted_vector(diagonal, above, value)
        if abs(better - value) < 1e-6 * value:
            z = twisted_vector(diagonal, above, better)[0]
        before = out[:, :j]
        if j and np.abs(before.T @ z).max() > 1e-12:
            # a cluster: inverse iteration, kept away from the vectors that are known
            near = value * (1 + 4 * EPS) + EPS * t[0, 0]
            for _ in range(4):
                z = z - before @ (before.T @ z)
                if np.linalg.norm(z) < 1e-8:
                    z = np.random.default_rng(j).standard_normal(len(z))
                    z -= before @ (before.T @ z)
                z = np.linalg.solve(t - near * np.eye(len(t)), z / np.linalg.norm(z))
                z /= np.linalg.norm(z)
            z = z - before @ (before.T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values above rounding, falling; their right singular vectors as columns), k at most.

    r has as many rows as columns, or fewer.  Of either sign of a vector that
    with its largest entry above 0.
    """
    if not r.size or not np.abs(r).max() > 0:
        return np.empty(0), np.empty((r.shape[1], 0))
    scale, square = float(np.abs(r).max()), np.zeros((r.shape[1], r.shape[1]))
    square[: len(r)] = r / scale
    diagonal, above, v = bidiagonalised(square)
    size = np.abs(diagonal).max(initial=0.0) + np.abs(above).max(initial=0.0)
    floor = EPS * size
    # negligible entries part the matrix; a zero on the diagonal is lifted to rounding size
    above = np.where(np.abs(above) <= 1e-3 * floor, 0.0, above)
    diagonal = np.where(np.abs(diagonal) <= 1e-3 * floor, 1e-3 * floor, diagonal)
    edges = [0, *(np.flatnonzero(above == 0) + 1).tolist(), len(diagonal)]
    blocks = [(a, b, dqds(diagonal[a:b], above[a : b - 1])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    every = np.concatenate([x for _, _, x in blocks])
    least = (len(diagonal) * EPS) ** 2 * every.max()
    chosen = [i for i in np.argsort(-every, kind="stable")[:k] if every[i] > least]
    owner = np.repeat(np.arange(len(blocks)), [len(x) for _, _, x in blocks])
    first = np.cumsum([0, *[len(x) for _, _, x in blocks]])
    vectors = np.zeros((len(diagonal), len(every)))
    for j in sorted({int(owner[i]) for i in chosen}):
        a, b, values = blocks[j]
        wanted = max(int(i - first[j]) for i in chosen if owner[i] == j) + 1
        vectors[a:b, first[j] : first[j] + wanted] = _block_vectors(diagonal[a:b], above[a : b - 1], values[:wanted])
    found = v @ vectors[:, chosen]
    found *= np.where(np.take_along_axis(found, np.abs(found).argmax(0)[None, :], 0) < 0, -1.0, 1.0)
    return every[chosen] * scale**2, found
