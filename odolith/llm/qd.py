"""Singular values and right singular vectors of a small square matrix: Householder bidiagonal form, dqds, twisted factorisations.

Works on one matrix of the size of a vector, whatever the number of rows it was reduced from.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and its factor so that x - factor * v (v . x) has nothing but its first entry."""
    v, size = x.copy(), float(np.linalg.norm(x))
    if size == 0:
        return v, 0.0
    v[0] += size if v[0] >= 0 else -size
    return v, 2 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal V of r = U B V', by reflections from both sides."""
    m, n = r.astype(float).copy(), r.shape[1]
    turn = np.eye(n)
    for k in range(n):
        v, f = reflector(m[k:, k])
        m[k:, k:] -= f * np.outer(v, v @ m[k:, k:])
        if k < n - 2:
            v, f = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= f * np.outer(m[k:, k + 1 :] @ v, v)
            turn[:, k + 1 :] -= f * np.outer(turn[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), turn


def dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference sweep with a shift: new q and e, and the differences d on the way. A negative d says that the shift was too large."""
    d, new_q, new_e, ds = q[0] - shift, [], [], [q[0] - shift]
    for i in range(len(e)):
        top = d + e[i]
        ratio = q[i + 1] / top if top else 0.0
        new_q.append(top)
        new_e.append(e[i] * ratio if top else 0.0)
        d = d * ratio - shift
        ds.append(d)
    return [*new_q, d], new_e, ds


def shifts(q: list[float], e: list[float]) -> list[float]:
    """Shifts to try in turn, the boldest first: from the last two rows less their residual, then a proven lower bound of the least value, then none."""
    ds = dqds_step(q, e, 0.0)[2]
    sure = (1 - 8 * EPS * len(q)) / sum(1 / d for d in ds) if min(ds) > 0 else 0.0
    a, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
    b2 = q[-2] * e[-1]
    low = (a + c) / 2 - np.hypot((a - c) / 2, np.sqrt(b2))
    residual = np.sqrt(q[-3] * e[-2] * b2 / (b2 + (a - low) ** 2)) if len(e) > 1 and b2 + (a - low) ** 2 > 0 else 0.0
    return [s for s in (float(low - residual), sure) if s > 0] + [0.0]


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix (a, b), in falling order, by dqds with deflation."""
    scale = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))) or 1.0
    parts, found = [([*((a / scale) ** 2)], [*((b / scale) ** 2)], 0.0)], []
    while parts:
        q, e, moved = parts.pop()
        while len(q) > 1:
            # an entry that can no longer change a value ends a part
            ends = [i for i, x in enumerate(e) if x <= EPS * EPS * (moved + min(q[i], q[i + 1]))]
            if ends:
                i = ends[-1]
                parts.append((q[: i + 1], e[:i], moved))
                q, e = q[i + 1 :], e[i + 1 :]
                continue
            for shift in shifts(q, e):
                new_q, new_e, ds = dqds_step(q, e, shift)
                if shift == 0 or min(ds) >= 0:
                    break
            q, e, moved = new_q, new_e, moved + shift
        found.append(moved + q[0])
    return np.sort(np.maximum(found, 0.0))[::-1] * scale**2


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue: stationary and progressive factorisations, joined where the twist is least."""
    n = len(a)
    least = EPS * EPS * float(max((a * a).max(), value, 1e-300))
    q = np.maximum(a * a, least)
    ld = a[:-1] * b
    stationary, progressive = np.empty(n), np.empty(n)
    low, up = np.empty(n - 1), np.empty(n - 1)
    s = -value
    for i in range(n):
        stationary[i] = s
        if i < n - 1:
            pivot = s + q[i]
            pivot = pivot if abs(pivot) > least * EPS else least * EPS
            low[i] = ld[i] / pivot
            s = low[i] * ld[i] / q[i] * s - value
    p = q[-1] - value
    for i in range(n - 1, -1, -1):
        progressive[i] = p
        if i:
            pivot = ld[i - 1] ** 2 / q[i - 1] + p
            pivot = pivot if abs(pivot) > least * EPS else least * EPS
            up[i - 1] = ld[i - 1] / pivot
            p = p * q[i - 1] / pivot - value
    r = int(np.abs(stationary + progressive + value).argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of r'r, falling, and unit eigenvectors as rows (zeros for a value of 0). Equal values have any orthonormal vectors of their space."""
    a, b, turn = bidiagonal(r)
    values = squared_values(a, b)
    square = np.diag(a * a + np.append(0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    rng, kept = np.random.default_rng(3), []
    for value in values[:k]:
        if value <= EPS * len(a) * values[0]:  # nothing varies along it
            kept.append((np.zeros(len(a)), value))
            continue
        z = twisted_vector(a, b, float(value))
        close = [y for y, v in kept if abs(v - value) <= 1e-6 * values[0]]
        for _ in range(4 if close else 0):
            for y in close:
                z = z - (z @ y) * y
            if np.linalg.norm(z) < 1e-4:  # the same vector again: another of its space
                z = rng.standard_normal(len(a))
                continue
            z = np.linalg.lstsq(square - (value + 4 * EPS * values[0]) * np.eye(len(a)), z / np.linalg.norm(z), rcond=None)[0]
            z = z / np.linalg.norm(z)
        for y in close * 2:
            z = z - (z @ y) * y
        kept.append((z / (np.linalg.norm(z) or 1.0), value))
    return values, np.array([turn @ z for z, _ in kept]).reshape(-1, len(a))
