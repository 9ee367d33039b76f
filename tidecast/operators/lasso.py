"""Exact solutions of a lasso from its normal equations, by following the path of the penalty.

Smallest value of ``b'Sb / 2 - r'b + lam * sum |b_j|`` with S positive definite. For a large penalty all coefficients are
zero. As it falls they are piecewise linear in it: between two events the coefficients of the active set move along a
line, and so do the correlations ``r - Sb`` of the others. An event is a correlation that reaches the penalty, whose
coefficient then enters, or a coefficient that reaches zero and leaves. There are finitely many. One path answers every
penalty on it.

The state is a principal pivot transform of [S | r]: a pivot on a coefficient takes it in or out. With s the signs of
the active ones, ``a`` the last column and ``b`` the transform times s, ``a - lam * b`` is the coefficient of an
active one and the correlation of another.
"""

from __future__ import annotations

import numpy as np

#: Events of a path beyond which the matrix is taken for singular, per coefficient; how far rounding may put an event back.
EVENTS, SLACK = 60, 1e-9


def solve(s: np.ndarray, r: np.ndarray, owner: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Coefficients (k, p) for k penalties ``lam`` > 0, that of number i on the path of S and r with number ``owner[i]``.

    ``s``: (m, p, p), ``r``: (m, p). All m paths take their steps together.
    """
    m, p = r.shape
    found = np.zeros((lam.size, p))
    if not p or not lam.size:
        return found
    table = np.concatenate([s, r[:, :, None]], axis=2).astype(float)
    signs, here = np.zeros((m, p)), np.full(m, np.inf)
    last, side = np.full(m, -1), np.zeros(m)
    least, rows, open_ = np.full(m, np.inf), np.arange(m), np.ones(lam.size, bool)
    np.minimum.at(least, owner, lam)
    for _ in range(EVENTS * p):
        a, b = table[:, :, p], np.einsum("mij,mj->mi", table[:, :, :p], signs)
        active, limit = signs != 0, here[:, None] * (1 + SLACK)
        with np.errstate(divide="ignore", invalid="ignore"):
            events = np.stack([np.where(active, a / b, a / (1 + b)), np.where(active, np.nan, a / (b - 1))])
        events[~((events > 0) & (events <= limit))] = -np.inf
        # What has just entered is at zero, what has just left is at the penalty: no event of their own.
        was = np.flatnonzero(last >= 0)
        out = side[was] != 0
        events[0, was, last[was]] = np.where(~out | (side[was] > 0), -np.inf, events[0, was, last[was]])
        events[1, was, last[was]] = np.where(out & (side[was] < 0), -np.inf, events[1, was, last[was]])
        best = events.max(axis=0)
        which = best.argmax(axis=1)
        there = np.minimum(best[rows, which], here)
        reached = open_ & (lam > there[owner])
        k = owner[reached]
        found[reached] = np.where(active[k], a[k] - lam[reached, None] * b[k], 0.0)
        open_ &= ~reached
        if not open_.any():
            return found
        # Only paths with a penalty left go on; the others are left as they are.
        go = there >= least
        j, i = which[go], rows[go]
        leaves = active[i, j]
        side[go], last[go] = np.where(leaves, signs[i, j], 0.0), j
        signs[i, j] = np.where(leaves, 0.0, np.sign(a[i, j] - there[i] * b[i, j]))
        here = np.where(go, there, here)
        table[go] = _pivoted(table[go], j)
    raise ArithmeticError("the path has no end: a singular matrix")


def _pivoted(table: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The principal pivot transform of every matrix on its coefficient ``j``."""
    n = np.arange(j.size)
    pivot = table[n, j, j].copy()
    line, column = table[n, j] / pivot[:, None], table[n, :, j].copy()
    out = table - column[:, :, None] * line[:, None, :]
    out[n, :, j] = -column / pivot[:, None]
    out[n, j] = line
    out[n, j, j] = 1 / pivot
    return out


def with_ridge(lhs: np.ndarray, rhs: np.ndarray, penalty: np.ndarray, lasso: slice, owner: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Smallest value of ``x'Ax / 2 - rhs'x + sum penalty_j x_j**2 / 2 + lam * sum |x_j|``, the last sum over ``lasso``.

    ``lhs``: (m, q, q), ``rhs``: (m, q), ``penalty``: (m, q), zero in ``lasso``. The free coefficients are eliminated first (a
    Schur complement), so the path has as many coefficients as ``lasso``. Returns (k, q) for the k pairs of ``owner``, ``lam``.
    """
    q = rhs.shape[1]
    diagonal = np.arange(q)
    inner = diagonal[lasso]
    outer = np.setdiff1d(diagonal, inner)
    a = lhs.copy()
    a[:, diagonal, diagonal] += penalty + 1e-10 * a[:, diagonal, diagonal].mean(axis=1, keepdims=True)
    cross = a[:, outer[:, None], inner]
    solved = np.linalg.solve(a[:, outer[:, None], outer], np.concatenate([cross, rhs[:, outer, None]], axis=2))
    tied, free = solved[:, :, : inner.size], solved[:, :, inner.size]
    turned = cross.transpose(0, 2, 1)
    schur = a[:, inner[:, None], inner] - turned @ tied
    found = solve(schur, rhs[:, inner] - (turned @ free[:, :, None])[:, :, 0], owner, lam)
    out = np.empty((lam.size, q))
    out[:, inner] = found
    out[:, outer] = free[owner] - np.einsum("kij,kj->ki", tied[owner], found)
    return out
