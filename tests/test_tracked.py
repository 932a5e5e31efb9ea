"""Potentials that are tracked from update to update reach the tolerance."""

import numpy as np
import pytest

from fovea.operators import kernels

K = 5
COST = np.abs(np.subtract.outer(np.arange(K), np.arange(K))) / (K - 1.0)
EPS = kernels.EPSILONS[-1]


def pairs_of(n=400):
    rng = np.random.default_rng(3)
    a = 0.98 * rng.dirichlet(np.ones(K) * 0.5, n) + 0.02 / K
    b = rng.multinomial(12, np.ones(K) / K, n) / 12.0  # with empty states
    return a, b


def row_error(a, b, f, g):
    plan = np.exp((f[:, :, None] + np.where(b > 0, g, -np.inf)[:, None, :] - COST) / EPS)
    return np.abs(plan.sum(2) - a).max(), np.abs(plan.sum(1) - b).max()


@pytest.mark.parametrize("own", [False, True])
def test_a_moved_pair_reaches_the_tolerance(own):
    a, b = pairs_of()
    assert (b == 0).any()
    start = kernels.balanced_potentials(a, a if own else b, COST)
    moved = a * np.exp(0.3 * np.random.default_rng(4).standard_normal(a.shape))
    moved /= moved.sum(1, keepdims=True)
    to = moved if own else b
    f, g = kernels._tracked_potentials(moved, to, COST, kernels.EPSILONS, tuple(x.copy() for x in start))
    assert max(row_error(moved, to, f, g)) <= 2 * kernels.TOL
    exact = kernels.balanced_potentials(moved, to, COST, (EPS,), 20000, 1e-12, tuple(x.copy() for x in start))
    value = lambda d: (d[0] * moved).sum(1) + (d[1] * to).sum(1)
    assert np.abs(value((f, g)) - value(exact)).max() <= 1e-6


def test_rows_that_newton_cannot_close_come_back_as_they_were():
    a, b = pairs_of(3)
    a[0] = [0.0, 0.25, 0.25, 0.25, 0.25]
    f, g = np.zeros_like(a), np.zeros_like(b)
    f[1] = 40.0 * np.arange(K)  # far off
    kept = f.copy()
    live = kernels._newton(a, b, f, g, COST, EPS, np.arange(3))
    assert 0 in live and (f[live] == kept[live]).all() and (g[live] == 0).all()


def test_hard_pairs_reach_the_tolerance():
    """A few in a hundred pairs kept their first, open potentials in every update, as neither iterations nor full steps closed them."""
    rng = np.random.default_rng(5)
    cost = np.array([[0, 1.42, 0.7, 0.26, 0.56], [1.42, 0, 1.84, 1.22, 1.17], [0.7, 1.84, 0, 0.83, 1.22], [0.26, 1.22, 0.83, 0, 0.47], [0.56, 1.17, 1.22, 0.47, 0]])
    a = 0.998 * rng.dirichlet(np.ones(K) * 0.3, 600) + 0.002 / K
    b = rng.multinomial(4, np.ones(K) / K, 600) / 4.0

    def open_rows(f, g):
        plan = np.exp((f[:, :, None] + np.where(b > 0, g, -np.inf)[:, None, :] - cost) / EPS)
        return (np.abs(plan.sum(2) - a).max(1) > 2 * kernels.TOL).sum()

    cold = kernels.balanced_potentials(a, b, cost)
    assert open_rows(*cold) > 0
    assert open_rows(*kernels._tracked_potentials(a, b, cost, kernels.EPSILONS, None)) < open_rows(*cold)
    assert open_rows(*kernels._tracked_potentials(a, b, cost, kernels.EPSILONS, cold)) == 0
