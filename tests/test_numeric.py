"""Two ways to the same number."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.functions import pvalues
from fovea.functions.ranks import exact_quantile, ordered_positions, value_ranks
from fovea.operators import kernels, resampling


def test_mann_whitney_exact_by_enumeration():
    a, b = [1.2, 3.4, 2.2, 9.0], [0.3, 1.1, 4.0, 5.0, 6.5]
    values = a + b
    u = sum(x > y for x in a for y in b)
    us = []
    for chosen in itertools.combinations(range(9), 4):
        rest = [values[i] for i in range(9) if i not in chosen]
        us.append(sum(values[i] > y for i in chosen for y in rest))
    tail = sum(v >= max(u, 20 - u) for v in us)
    assert pvalues.mann_whitney(u, 4, 5, 0.0) == pytest.approx(min(1.0, 2 * tail / len(us)))


def test_signed_rank_exact_by_enumeration():
    deltas = [0.5, -1.5, 2.5, 3.5, -0.7, 4.0]
    ranks = np.argsort(np.argsort(np.abs(deltas))) + 1
    w = sum(r for r, d in zip(ranks, deltas) if d > 0)
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=6)]
    tail = sum(s >= max(w, 21 - w) for s in sums)
    assert pvalues.signed_rank(w, 6, 0.0, False, True) == pytest.approx(min(1.0, 2 * tail / 64))


def test_sign_test_and_f_tail():
    assert pvalues.sign_test(5, 0) == pytest.approx(2 / 32)
    assert pvalues.sign_test(3, 3) == 1.0 and pvalues.sign_test(0, 0) is None
    # df1 = 2 has the closed form (1 + 2 f / df2)^(-df2 / 2)
    for f, d in ((0.5, 7.0), (3.2, 12.0), (40.0, 5.0)):
        assert pvalues.f_tail(f, 2.0, d) == pytest.approx((1 + 2 * f / d) ** (-d / 2))
    exact = sum(math.comb(600, i) for i in range(330, 601)) * 2 / 2**600
    assert pvalues.sign_test(330, 270) == pytest.approx(exact, rel=1e-9)


def test_value_ranks_and_quantiles(spark):
    rng = np.random.default_rng(3)
    data = [("g%d" % (i % 3), float(v)) for i, v in enumerate(np.round(rng.normal(size=900), 2))]
    data += [("g0", 0.25)] * 400 + [("g1", 50.0)]
    df = spark.createDataFrame(data, "g string, v double")
    for prob in (0.0, 0.31, 0.5, 0.99, 1.0):
        got = {r.g: r.q for r in exact_quantile(df, ["g"], "v", prob, "q").collect()}
        for g in ("g0", "g1", "g2"):
            assert got[g] == pytest.approx(np.quantile([v for k, v in data if k == g], prob))
    ranked = {r.v: r.avg_rank for r in value_ranks(df.where("g = 'g0'"), ["g"], "v").collect()}
    own = sorted(v for k, v in data if k == "g0")
    for v, rank in ranked.items():
        assert rank == pytest.approx(np.mean([i + 1 for i, x in enumerate(own) if x == v]))


def test_ordered_positions_span_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("g"), F.lpad(F.col("id").cast("string"), 4, "0").alias("k"))
    out = ordered_positions(df, ["g"], ["k"], "pos", "n")
    assert out.select(F.max("n")).first()[0] == 500
    for r in out.where("pos in (1, 17, 500)").collect():
        assert int(r.k) == 2 * (r.pos - 1) + int(r.g)


def test_weighted_quantile_with_ties(spark):
    rng = np.random.default_rng(5)
    values, weights = np.round(rng.random(200), 1), rng.random(200)
    df = spark.createDataFrame([(float(v), float(w)) for v, w in zip(values, weights)], "v double, w double")
    order = np.lexsort((weights, values))
    v, w = values[order], weights[order]
    centres = (np.cumsum(w) - 0.5 * w) / w.sum()
    for q in (0.0, 0.07, 0.5, 0.93, 1.0):
        got = resampling.weighted_quantile(df, [], "v", "w", q).first()[0]
        assert got == pytest.approx(np.interp(q, centres, v))


def test_unbalanced_plan_meets_its_fixed_point():
    rng = np.random.default_rng(2)
    a, b = rng.dirichlet(np.ones(4), 6), rng.dirichlet(np.ones(4), 6)
    cost = np.abs(np.subtract.outer(np.arange(4), np.arange(4))) / 2.0
    penalty, eps = 0.4, kernels.MATCH_EPSILONS[-1]
    plan, settled = kernels.unbalanced_plans(a, b, np.ones_like(a, bool), np.full(6, penalty), cost)
    assert settled.all()
    assert not kernels.unbalanced_plans(a, b, np.ones_like(a, bool), np.full(6, penalty), cost, max_iter=1)[1].any()
    slack = (np.log(plan.sum(2)) - np.log(a))[:, :, None] + (np.log(plan.sum(1)) - np.log(b))[:, None, :]
    assert np.allclose(np.log(plan) + cost / eps, -penalty / eps * slack, atol=1e-5)
    strict, _ = kernels.unbalanced_plans(a, b, np.ones_like(a, bool), np.full(6, 500.0), cost)
    assert np.allclose(strict.sum(2), a, atol=1e-2) and np.allclose(strict.sum(1), b, atol=1e-2)


def test_matching_isolates_failures(spark):
    rows = [("ok", [0.5, 0.5], [0.4, 0.6]), ("no_source", [0.0, 0.0], [0.5, 0.5]), ("no_target", [0.5, 0.5], [0.0, 0.0])]
    pairs = spark.createDataFrame(rows, "pair_id string, a array<double>, b array<double>").withColumn("penalty", F.lit(1.0))
    got = {r.pair_id: r for r in kernels.match_pairs(pairs, np.array([[0, 1.0], [1.0, 0]])).collect()}
    assert got["ok"].status == "ok" and len(got["ok"].plan) == 4 and got["ok"]["T"] > 0
    assert got["no_source"].status == "ERR_UOT_EMPTY_MASS_SOURCE" and got["no_source"]["T"] is None
    assert got["no_target"].status == "ERR_UOT_EMPTY_MASS_TARGET"


def test_step_gradient_matches_differences():
    rng = np.random.default_rng(4)
    k = 3
    q, b = rng.dirichlet(np.ones(k), 5), rng.dirichlet(np.ones(k), 5)
    cost = np.abs(np.subtract.outer(np.arange(k), np.arange(k))) / 2.0
    t, e = kernels.start_relation(k)
    t = t * 0.5 + rng.dirichlet(np.ones(k + 1), k) * 0.5
    w = np.full(5, 0.2)

    def loss(t_):
        _, p = kernels._predict(q, t_, e)
        values = [kernels.balanced_value(u, v, cost, (0.1,), 4000, 1e-13) for u, v in ((p, b), (p, p), (b, b))]
        return values[0] - 0.5 * values[1] - 0.5 * values[2]

    def total(t_):
        l_ = loss(t_)
        return (w * l_).sum() + (w * (l_ - (w * l_).sum()) ** 2).sum()

    gb, hb = kernels.balanced_potentials(b, b, cost, (0.1,), 4000, 1e-13)
    warm = [(np.zeros_like(b), np.zeros_like(b)), (np.zeros_like(b), np.zeros_like(b)), 0.5 * ((gb + hb) * b).sum(1)]
    for _ in range(400):
        fit, gt, ge, warm = kernels._step_gradient(q, b, w, t, e, cost, 1.0, warm)
    assert fit == pytest.approx(total(t), abs=1e-6)
    for i, j in ((0, 1), (2, 0), (1, 1)):
        up, down = t.copy(), t.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        assert gt[i, j] == pytest.approx((total(up) - total(down)) / 2e-5, rel=1e-3, abs=1e-5)


def test_loss_of_a_step_is_the_converged_divergence():
    rng = np.random.default_rng(9)
    k = 4
    q, b = rng.dirichlet(np.ones(k), 30), rng.dirichlet(np.ones(k) * 0.3, 30)
    cost = np.abs(np.subtract.outer(np.arange(k), np.arange(k))) / 3.0
    t, e = kernels.start_relation(k)
    g, h = kernels.balanced_potentials(b, b, cost, (0.1,), 4000, 1e-13)
    loss, _, _ = kernels._pair_terms(q, b, 0.5 * ((g + h) * b).sum(1), t, e, cost, 1.0)
    _, p = kernels._predict(q, t, e)
    values = [kernels.balanced_value(u, v, cost, (0.1,), 4000, 1e-13) for u, v in ((p, b), (p, p), (b, b))]
    assert loss == pytest.approx(values[0] - 0.5 * values[1] - 0.5 * values[2], abs=1e-5)
