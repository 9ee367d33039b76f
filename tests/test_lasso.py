from __future__ import annotations

import numpy as np
import pytest

from tidecast.operators import forecast, lasso


def sub_gradient(s, r, lam, b):
    """How far a solution is from the conditions of optimality, as a share of the penalty."""
    slope = r - s @ b
    return max(np.where(b != 0, np.abs(slope - lam * np.sign(b)), np.maximum(np.abs(slope) - lam, 0)) / lam)


def hinges(days, points):
    t = np.linspace(0, 1, days)
    return np.column_stack([np.ones(days), t, *[np.maximum(t - p, 0) for p in points]])


@pytest.mark.parametrize("seed", range(8))
def test_paths_are_optimal_at_every_penalty(seed):
    """Correlated regressors, so that coefficients leave and come back; many penalties on each of several paths."""
    rng = np.random.default_rng(seed)
    m, p = 5, 12
    x = np.cumsum(rng.normal(size=(m, 40, p)), axis=1 + seed % 2) + 0.1 * rng.normal(size=(m, 40, p))
    y = rng.normal(size=(m, 40))
    s, r = x.transpose(0, 2, 1) @ x, np.einsum("mnp,mn->mp", x, y)
    owner = np.repeat(np.arange(m), 30)
    lam = np.tile(np.geomspace(1e-4, 2, 30), m) * np.abs(r).max(axis=1)[owner]
    found = lasso.solve(s, r, owner, lam)
    assert all(sub_gradient(s[k], r[k], v, b) < 1e-6 for k, v, b in zip(owner, lam, found))
    assert not found[lam > np.abs(r).max(axis=1)[owner]].any()
    alone = np.array([lasso.solve(s[[k]], r[[k]], np.array([0]), np.array([v]))[0] for k, v in zip(owner, lam)])
    assert np.allclose(alone, found, rtol=1e-7, atol=1e-9)


def test_one_coefficient_and_none():
    s, r = np.array([[[2.0]]]), np.array([[3.0]])
    assert lasso.solve(s, r, np.zeros(3, int), np.array([1.0, 3.0, 4.0])).ravel() == pytest.approx([1.0, 0.0, 0.0])
    assert lasso.solve(np.zeros((1, 0, 0)), np.zeros((1, 0)), np.zeros(2, int), np.ones(2)).shape == (2, 0)


@pytest.mark.parametrize("days", [30, 90, 900])
def test_additive_fit_is_the_optimum(days):
    """Gradient and sub-gradient of the whole objective vanish, in trend, season and trend changes together."""
    rng = np.random.default_rng(days)
    points = np.linspace(0, 0.8, 26)[1:]
    trend, t = hinges(days, points), np.arange(days)
    season = np.column_stack([f(2 * np.pi * k * t / 7) for k in (1, 2, 3) for f in (np.sin, np.cos)]
                             + [f(2 * np.pi * k * t / 365.25) for k in range(1, 11) for f in (np.sin, np.cos)])
    n, mean = rng.integers(1, 4, days).astype(float), 0.4 + 0.3 * np.abs(t / days - 0.5) + 0.05 * np.sin(t) + 0.05 * rng.normal(size=days)
    squares = float((n * mean**2).sum()) + 0.01
    cps, sps = np.array([0.001, 0.05, 0.5, 0.5]), np.array([0.1, 10.0, 10.0, 0.01])
    a, b = forecast.fit_settings(trend, season, n, mean, squares, False, cps, sps)
    both = np.hstack([trend, season])
    products, moments = both.T @ (n[:, None] * both), both.T @ (n * mean)
    variance = forecast._noise_variance(products, moments, squares, n.sum())
    jitter = 1e-10 * np.diag(products).mean()
    for k in range(4):
        found = np.concatenate([a[k], b[k]])
        slope = moments - products @ found - jitter * found
        slope[trend.shape[1] :] -= variance / sps[k] ** 2 * b[k]
        lam, changes = variance / cps[k], slice(2, trend.shape[1])
        changed = found[changes]
        off = np.where(changed != 0, np.abs(slope[changes] - lam * np.sign(changed)), np.maximum(np.abs(slope[changes]) - lam, 0))
        free = np.abs(np.delete(slope, np.arange(2, trend.shape[1])))
        assert max(off.max(), free.max()) < 1e-8 * max(1.0, np.abs(moments).max())
