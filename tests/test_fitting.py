"""Fitted relations against a dense fit of all patients in step."""

import numpy as np
import pytest

from fovea import runtime
from fovea.operators import fitting, kernels

SCHEMA = "relation_id string, patient_id string, subbag_index int, pair_id string, a array<double>, b array<double>"
K = 3
COST = np.abs(np.subtract.outer(np.arange(K), np.arange(K))) / 2.0


def rows_of(patients=5, blocks=4, hot=0):
    rng = np.random.default_rng(6)
    rows = []
    for p in range(patients):
        move = rng.dirichlet(np.ones(K) * 0.3, K)
        for s in range(blocks + (hot if p == 0 else 0)):
            for n in range(1 + s % 3):
                a = rng.dirichlet(np.ones(K))
                rows.append((f"r{p % 2}", f"p{p}", s, f"p{p}|{s}|{n}", a.tolist(), (0.9 * a @ move + 0.1 * rng.dirichlet(np.ones(K))).tolist()))
    return rows


def dense(rows, updates):
    """The same objective with all patients of a relation as arrays, one update of all at a time."""
    relations = sorted({r[0] for r in rows})
    patients = sorted({r[:2] for r in rows})
    who = np.array([patients.index(r[:2]) for r in rows])
    group = np.array([relations.index(r) for r, _ in patients])
    q, b = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    block = [r[:3] for r in rows]
    n_blocks = {p: len({x for x in block if x[:2] == p}) for p in patients}
    w = np.array([1.0 / (block.count(x) * n_blocks[x[:2]]) for x in block])
    scale = np.array([max(np.mean(kernels.divergence(q[group[who] == r], b[group[who] == r], COST)), kernels.SCALE_FLOOR) for r in range(len(relations))])[group]
    g, h = kernels.balanced_potentials(b, b, COST)
    own = 0.5 * ((g + h) * b).sum(1)
    t0, e0 = kernels.start_relation(K)
    t, e = np.repeat(t0[None], len(patients), 0), np.repeat(e0[None], len(patients), 0)
    free = [np.log(np.maximum(t, 1e-12)), np.log(np.maximum(e, 1e-12) / np.maximum(1 - e, 1e-12))]
    m, v, warm, value = [np.zeros_like(x) for x in free], [np.zeros_like(x) for x in free], (None, None), None
    for i in range(1, updates + 1):
        loss, draw, warm = kernels._pair_terms(q, b, own, t[who], e[who], COST, scale[who], warm)
        sums = np.zeros((len(patients), 2 + 2 * (K * K + K)))
        np.add.at(sums, who, kernels._pair_sums(q, w, loss, draw))
        fit, gt, ge = kernels._from_sums(sums, K)
        mean = lambda x: np.stack([x[group == r].mean(0) for r in range(len(relations))])[group]
        off_t, off_e = t - mean(t), e - mean(e)
        value = (fit + (t[:, :, -1].mean(1) + e.mean(1) + kernels.GEOMETRY_WEIGHT * (t[:, :, :-1] * COST).sum((1, 2)) / K) / 2
                 + ((off_t**2).sum(2).mean(1) + (off_e**2).mean(1)) / kernels.COHORT_SCALE) / 3
        gt = gt + 2 * off_t / K / kernels.COHORT_SCALE
        gt[:, :, :-1] += kernels.GEOMETRY_WEIGHT * COST / K / 2
        gt[:, :, -1] += 0.5 / K
        ge = ge + 0.5 / K + 2 * off_e / K / kernels.COHORT_SCALE
        for j, gx in enumerate([t * (gt - (gt * t).sum(2, keepdims=True)) / 3, ge * e * (1 - e) / 3]):
            m[j], v[j] = 0.9 * m[j] + 0.1 * gx, 0.999 * v[j] + 0.001 * gx * gx
            free[j] = free[j] - fitting._rate(i) * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.999**i)) + 1e-8)
        ez = np.exp(free[0] - free[0].max(2, keepdims=True))
        t, e = ez / ez.sum(2, keepdims=True), 1 / (1 + np.exp(-free[1]))
    out = {}
    for p, tt, ee in zip(patients, t, e):
        for i in range(K):
            out[(*p, "d", i, K)], out[(*p, "e", K, i)] = tt[i, K], ee[i]
            out |= {(*p, "A", i, j): tt[i, j] for j in range(K)}
    return out, {r: value[group == n].mean() for n, r in enumerate(relations)}


def entries_of(fit):
    return {(r.relation_id, r.patient_id, r.entry_type, r.row_id, r.col_id): r.value for r in fit.entries.collect()}


@pytest.mark.parametrize(("part_pairs", "spread"), [(4096, 1), (4096, 7), (9, 3)])
def test_fit_equals_a_dense_fit(spark, part_pairs, spread):
    """However the pairs lie, and with a patient of one relation cut into parts."""
    rows = rows_of(hot=6)
    fit = fitting.fit_relations(spark.createDataFrame(rows, SCHEMA).repartition(spread), COST, K, rounds=3, steps=4, part_pairs=part_pairs)
    want, value = dense(rows, 12)
    got = entries_of(fit)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert fit.history[-1] == pytest.approx(value, abs=1e-8)
    assert len(fit.history) == 3


def test_plans_of_split_patients_grow_by_the_update(spark, monkeypatch):
    """Rows and totals of one update came from the same plan, which doubled with every update between two writes."""
    sizes, step = [], fitting._updated_parts

    def measured(state, task):
        frames = step(state, task)
        sizes.append(len(frames[-1]._jdf.queryExecution().logical().toString()))
        return frames

    monkeypatch.setattr(fitting, "_updated_parts", measured)
    fitting.fit_relations(spark.createDataFrame(rows_of(3, 6), SCHEMA), COST, K, rounds=1, steps=7, part_pairs=5)
    assert len(sizes) == 7
    assert sizes[6] - sizes[5] < 1.5 * (sizes[1] - sizes[0])


def test_fit_stops_at_the_plateau_with_the_state_before_it(spark, monkeypatch):
    monkeypatch.setattr(fitting, "MIN_MAIN_STEPS", -15)
    monkeypatch.setattr(fitting, "PLATEAU_CHANGE", 1.0)
    rows = rows_of(3, 2)
    fit = fitting.fit_relations(spark.createDataFrame(rows, SCHEMA), COST, K, rounds=5, steps=6)
    # from update 5 on every change counts as calm; the fifth of them, number 9, is not taken
    want, _ = dense(rows, 8)
    got = entries_of(fit)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_bad_pairs_do_not_spoil_the_others(spark):
    rows = rows_of()
    bad = [("r0", "bad1", 0, "x", [float("nan"), 0.5, 0.5], rows[0][5]), ("r0", "bad2", 0, "y", [0.9, 0.9, 0.0], rows[0][5]), ("r0", "bad3", 0, "z", None, rows[0][5]), ("r0", "bad4", 0, "v", [1.0], rows[0][5])]
    fit = fitting.fit_relations(spark.createDataFrame(rows + bad, SCHEMA), COST, K, rounds=1, steps=3)
    clean = fitting.fit_relations(spark.createDataFrame(rows, SCHEMA), COST, K, rounds=1, steps=3)
    got, want = entries_of(fit), entries_of(clean)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    status = {r.patient_id: r.status for r in fit.ledger.collect()}
    assert {p for p, s in status.items() if s == fitting.BAD_PAIRS} == {"bad1", "bad2", "bad3", "bad4"}
    assert all(s == fitting.OK for p, s in status.items() if not p.startswith("bad"))


def test_ledger_adds_up_and_the_objective_falls(spark):
    fit = fitting.fit_relations(spark.createDataFrame(rows_of(), SCHEMA), COST, K, rounds=2, steps=20)
    assert all(fit.history[-1][r] < fit.history[0][r] for r in ("r0", "r1"))
    for r in fit.ledger.collect():
        prior = (r.open + kernels.GEOMETRY_WEIGHT * r.geometry) / 2
        assert r.objective == pytest.approx((r.observation + r.consistency + prior + r.recurrence / kernels.COHORT_SCALE) / 3)
        assert r.status == "ok" and r.n_pairs > 0
    nothing = fitting.fit_relations(spark.createDataFrame([], SCHEMA), COST, K, rounds=1, steps=2)
    assert nothing.entries.count() == 0 and nothing.ledger.count() == 0


def test_updates_leave_no_plans_with_the_driver(spark):
    """Every update planned and recorded a query of its own, of many tasks for a patient of over 4,096 pairs: at 1 GB that filled the driver."""
    rng = np.random.default_rng(8)
    a, b = rng.dirichlet(np.ones(K), 5000), rng.dirichlet(np.ones(K), 5000)
    rows = rows_of(3, 2) + [("r0", "large", i, f"l{i}", a[i].tolist(), b[i].tolist()) for i in range(5000)]
    frame = spark.createDataFrame(rows, SCHEMA).localCheckpoint()
    plans = spark._jsparkSession.sharedState().statusStore()

    def used(steps):
        before = plans.executionsCount()
        fit = fitting.fit_relations(frame, COST, K, rounds=1, steps=steps)
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return plans.executionsCount() - before, fit

    (few, _), (more, fit) = used(2), used(9)
    assert more == few
    assert {r.patient_id: r.n_pairs for r in fit.ledger.collect()}["large"] == 5000


def test_checkpoints_of_a_fit_go_below_the_shared_folder_and_are_dropped(spark):
    before = set(runtime.written_stages())
    fit = fitting.fit_relations(spark.createDataFrame(rows_of(), SCHEMA), COST, K, rounds=3, steps=4)
    want, _ = dense(rows_of(), 12)
    got = entries_of(fit)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    left = set(runtime.written_stages()) - before
    assert all("/rdd-" not in folder for folder in left)
