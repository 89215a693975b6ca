"""Singular values and right singular vectors of a small square matrix: bidiagonal form, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections from both sides: diagonal, superdiagonal, and the right factor ``w`` (matrix = u b w^T)."""
    a = np.array(matrix, np.float64)
    n = len(a)
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        if not np.any(x[1:]):
            return None
        v = x / np.abs(x).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1 :].copy()) if k + 2 < n else None
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential quotient-difference step with a shift; None where the shift is beyond the least value."""
    out_q, out_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        out_q[i] = d + e[i]
        t = q[i + 1] / out_q[i]
        out_e[i] = e[i] * t
        d = d * t - shift
    out_q[-1] = d
    return None if d < 0 else (out_q, out_e)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, falling."""
    tolerance = (4 * _EPS) ** 2
    found: list[float] = []
    todo = [(diagonal**2, above**2, 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while len(q):
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            loose = e <= tolerance * (sigma + np.minimum(q[1:], q[:-1]))
            if loose.any():
                at = int(np.flatnonzero(loose)[-1]) + 1
                todo.append((q[:at], e[: at - 1], sigma))
                q, e = q[at:], e[at:]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # The least value of the last two rows is above the least of all; the off-diagonal beside them bounds by how much.
            mean, gap = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            shift = max(0.0, gap / (mean + np.sqrt(max(0.0, mean * mean - gap))) if mean else 0.0)
            shift = max(0.0, shift - np.sqrt(e[-2] * q[-2]) if len(e) > 1 else shift * (1 - 8 * _EPS))
            done = None
            for factor in (1.0, 0.5, 0.125, 0.0):
                done = _sweep(q, e, factor * shift)
                if done is not None:
                    sigma += factor * shift
                    break
            q, e = done
    return np.sort(np.array(found))[::-1]


def _twisted(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, float, np.ndarray]:  # noqa: E741
    """The vector of the best twisted factorisation of L D L^T - value, its residual, and the diagonal of the first half."""
    n, tiny = len(d), np.finfo(np.float64).tiny
    plus, lower = np.empty(n), np.empty(max(0, n - 1))
    upper, s, p = np.empty(max(0, n - 1)), np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n):
        plus[i] = s[i] + d[i] or tiny
        if i < n - 1:
            lower[i] = d[i] * l[i] / plus[i]
            s[i + 1] = lower[i] * l[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / (d[i] * l[i] * l[i] + p[i + 1] or tiny)
        upper[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    r = int(np.nanargmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -upper[i] * z[i]
    norm = np.linalg.norm(z)
    return z / norm, gamma[r] / norm**2, plus


def directions(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors, one column per value of ``squares`` (falling).

    Each is the vector of the twisted factorisation with the least twist element. Values closer than rounding allows to
    tell their vectors apart share a subspace; there, vectors are made orthogonal to those before by inverse iteration.
    """
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)) or 1.0
    a = np.where(np.abs(diagonal) < _EPS * scale, _EPS * scale, diagonal)
    d, l = a * a, above / a[:-1]  # noqa: E741
    full = np.diag(a) + np.diag(above, 1)
    out = np.empty((n, len(squares)))
    rng = np.random.default_rng(0)
    for k, value in enumerate(squares):
        with np.errstate(all="ignore"):
            z, residual, _ = _twisted(d, l, value)
            better, rest, _ = _twisted(d, l, value + residual)
        if np.isfinite(better).all() and abs(rest) <= abs(residual):
            z = better
        near = [j for j in range(k) if squares[j] - value <= 1e-5 * max(squares[0], np.finfo(float).tiny)]
        before = out[:, near]
        z = z - before @ (before.T @ z)
        if not np.isfinite(z).all() or np.linalg.norm(z) < 0.9:
            z = rng.normal(size=n)
            shifted = full.T @ full - (value + 4 * _EPS * max(squares[0], _EPS)) * np.eye(n)
            for _ in range(4):
                z -= before @ (before.T @ z)
                z = np.linalg.solve(shifted, z / np.linalg.norm(z))
                z /= np.linalg.norm(z)
            z -= before @ (before.T @ z)
        out[:, k] = z / np.linalg.norm(z)
    return out


def right_singular(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and the right singular vectors as columns."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(matrix).max() or 1.0
    diagonal, above, w = bidiagonalise(matrix / scale)
    squares = dqds(diagonal, above)
    return squares * scale**2, w @ directions(diagonal, above, squares)
