"""Dense numeric kernels over Arrow batches: transport between compositions, relation fitting.

Spark spreads and shuffles the pair rows; a kernel only ever sees one batch of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.functions.ranks import at_quantile, value_ranks
from fovea.operators.estimate import closest_candidate, screen_pairs
from fovea.runtime import spread
from fovea.schema import REL_PATIENT

# Settings of the balanced transport.
EPSILONS = (0.5, 0.2, 0.1)
MAX_ITER = 100
TOL = 1e-6
NEGATIVE_TOL = 1e-10
CHUNK = 512
#: Iterations between two kernels.
ABSORB = 25


def cost_array(cost: DataFrame, n_states: int) -> np.ndarray:
    """State-sized cost matrix as a numpy array on the driver."""
    out = np.zeros((n_states, n_states))
    for r in cost.select("i", "j", "cost").collect():
        out[r["i"], r["j"]] = r["cost"]
    return out


def _lse(m: np.ndarray, axis: int) -> np.ndarray:
    top = m.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(m - top).sum(axis=axis)) + np.squeeze(top, axis)


def _log(v: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(v)


def balanced_potentials(a, b, cost, epsilons=EPSILONS, max_iter=MAX_ITER, tol=TOL, start=None):
    """Dual potentials of entropic transport for a batch of pairs; converged rows are frozen. ``cost`` is one matrix, or one per pair.

    Between two absorptions an iteration is two products with the kernel of the potentials
    so far; taking the potentials in regularly keeps the factors in range.
    """
    f, g = start if start is not None else (np.zeros_like(a), np.zeros_like(b))
    for eps in epsilons:
        live = np.arange(a.shape[0])
        for done in range(0, max_iter, ABSORB):
            live = _scaled(a, b, f, g, cost, eps, min(ABSORB, max_iter - done), tol, live)
            if live.size == 0:
                break
    return f, g


#: Entries of a kernel up to which all pairs of a batch are multiplied together, entry by entry.
SMALL_KERNEL = 256


def together(n_states: int) -> int:
    """Pairs that are solved in one call: more where their kernels are small, as a call has its price."""
    return min(8 * CHUNK, max(CHUNK, CHUNK * SMALL_KERNEL // n_states**2))


def _products(kernel: np.ndarray):
    """The kernels of a batch in the layout that suits their size, and products from the right, from the left, and a choice of pairs.

    Vectors have their states first: a product of small kernels is then a sum of long rows.
    """
    if kernel[0].size <= SMALL_KERNEL:
        rows = np.ascontiguousarray(kernel.transpose(1, 2, 0))
        return rows, lambda m, v: (m * v).sum(1), lambda m, u: (m * u[:, None]).sum(0), lambda m, on: m[:, :, on]
    return kernel, lambda m, v: (m @ v.T[:, :, None])[:, :, 0].T, lambda m, u: (m.transpose(0, 2, 1) @ u.T[:, :, None])[:, :, 0].T, lambda m, on: m[on]


def _scaled(a, b, f, g, cost, eps, max_iter, tol, live):
    """Up to ``max_iter`` iterations on the live rows, written back to ``f`` and ``g``; the rows still live."""
    if live.size == 0:
        return live
    al, bl, costs = a[live], b[live], cost if cost.ndim == 2 else cost[live]
    fm, gm = np.where(al > 0, f[live], -np.inf), np.where(bl > 0, g[live], -np.inf)
    # shifted so that the largest entry of every row of the kernel is about one
    rows = (gm[:, None, :] - costs).max(2)
    fm = np.where(al > 0, -rows, -np.inf)
    kernel, right, left, chosen = _products(np.exp((fm[:, :, None] + gm[:, None, :] - costs) / eps))
    al, bl, fm, gm = (np.ascontiguousarray(x.T) for x in (al, bl, fm, gm))
    u, v = np.ones_like(al), np.where(bl > 0, 1.0, 0.0)
    side, still = right(kernel, v), np.ones(live.size, bool)

    def keep(on):
        at = live[on]
        f[at] = np.where(al[:, on] > 0, fm[:, on] + eps * np.log(u[:, on]), 0.0).T
        g[at] = np.where(bl[:, on] > 0, gm[:, on] + eps * np.log(v[:, on]), 0.0).T
        return at

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(max_iter):
            u = np.where(al > 0, al / side, 0.0)
            v = np.where(bl > 0, bl / left(kernel, u), 0.0)
            side = right(kernel, v)
            new = (np.abs(u * side - al).max(0) <= tol) & still
            if new.any():
                keep(new)
                still &= ~new
                if not still.any():
                    return live[:0]
                if 2 * still.sum() < still.size:  # drop what is done
                    al, bl, fm, gm, u, v, side = (x[:, still] for x in (al, bl, fm, gm, u, v, side))
                    kernel, live, still = chosen(kernel, still), live[still], np.ones(still.sum(), bool)
        return keep(still)


def balanced_value(a, b, cost, epsilons=EPSILONS, max_iter=MAX_ITER, tol=TOL) -> np.ndarray:
    """Regularised transport value per pair at the last epsilon."""
    f, g = balanced_potentials(a, b, cost, epsilons, max_iter, tol)
    eps = epsilons[-1]
    fm, gm = np.where(a > 0, f, -np.inf), np.where(b > 0, g, -np.inf)
    plan = np.exp((fm[:, :, None] + gm[:, None, :] - cost) / eps)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(plan > 0, plan * (np.log(plan) - 1.0), 0.0)
    return (plan * cost).sum((1, 2)) + eps * entropy.sum((1, 2))


def divergence(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Debiased transport divergence per pair; tiny negatives become zero, larger ones NaN."""
    cross = 0.5 * (balanced_value(a, b, cost) + balanced_value(b, a, cost.T))
    out = cross - 0.5 * balanced_value(a, a, cost) - 0.5 * balanced_value(b, b, cost)
    return np.where(out < -NEGATIVE_TOL, np.nan, np.maximum(out, 0.0))


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in series])


def pair_divergences(pairs: DataFrame, cost: np.ndarray) -> DataFrame:
    """Adds ``cost`` (divergence of ``a`` and ``b``) to every pair row.

    Pairs of one block are spread over all tasks; nothing is grouped.
    """
    keys = [f for f in pairs.schema.fields if f.name not in ("a", "b")]
    names, most = [f.name for f in keys], together(len(cost))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), most):
                part = batch.iloc[lo : lo + most]
                out = part[names].copy()
                values = divergence(_stack(part["a"]), _stack(part["b"]), cost)
                out["cost"] = [None if np.isnan(v) else float(v) for v in values]
                yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", cost double"
    return spread(pairs).mapInPandas(run, schema)


def block_divergences(pair_costs: DataFrame) -> DataFrame:
    """Loss of a block: the mean divergence of its pairs.

    One side of a block is a single FOV, so the transport plan between the two
    sides is forced and the mean is its cost.
    """
    return pair_costs.groupBy(*REL_PATIENT, "subbag_index").agg(F.avg("cost").alias("loss"), F.count("cost").alias("n_pairs"))


# --- unbalanced matching -----------------------------------------------------

# Settings of the unbalanced matching.
MATCH_EPSILONS = (1.0, 0.2)
MATCH_MAX_ITER = 2000
MATCH_TOL = 1e-7


def unbalanced_plans(a, b, active, penalty, cost, epsilons=MATCH_EPSILONS, max_iter=MATCH_MAX_ITER, tol=MATCH_TOL):
    """Transport plans with a penalty on unmatched mass, one per pair of the batch, and which converged.

    A pair that still moves after ``max_iter`` iterations at any epsilon has not converged.
    """
    av, bv = np.where(active, a, 0.0), np.where(active, b, 0.0)
    log_a, log_b = _log(av), _log(bv)
    lu, lv = np.zeros_like(av), np.zeros_like(bv)
    settled = np.ones(a.shape[0], bool)
    for eps in epsilons:
        kernel = -cost / eps
        damp = (penalty / (penalty + eps))[:, None]
        live = np.arange(a.shape[0])
        for _ in range(max_iter):
            u = np.where(av[live] > 0, damp[live] * (log_a[live] - _lse(kernel + np.where(bv[live] > 0, lv[live], -np.inf)[:, None, :], 2)), -np.inf)
            v = np.where(bv[live] > 0, damp[live] * (log_b[live] - _lse(kernel + u[:, :, None], 1)), -np.inf)
            with np.errstate(invalid="ignore"):
                moved = np.maximum(np.nanmax(np.abs(np.where(av[live] > 0, u - lu[live], 0.0)), 1), np.nanmax(np.abs(np.where(bv[live] > 0, v - lv[live], 0.0)), 1))
            lu[live], lv[live] = u, v
            live = live[~(moved < tol)]
            if live.size == 0:
                break
        settled[live] = False
    lu = np.where(av > 0, lu, -np.inf)
    lv = np.where(bv > 0, lv, -np.inf)
    return np.exp(lu[:, :, None] - cost / epsilons[-1] + lv[:, None, :]), settled


def match_pairs(pairs: DataFrame, cost: np.ndarray, n_min: float = 0.0, keep_plan: bool = True) -> DataFrame:
    """Screen and match every pair (columns ``a``, ``b``, ``penalty``); failures keep their status.

    Returns matched, unmatched and cost totals per pair, and the plan as one
    array of K * K numbers when asked for.
    """
    screened = screen_pairs(pairs, n_min).drop("mass_pruned_ratio")
    keys = [f for f in screened.schema.fields if f.name not in ("a", "b", "active", "status")]
    names = [f.name for f in keys]
    measured = ["T", "D_pos", "B_pos", "d_rel", "b_rel", "M"]

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                part = batch.iloc[lo : lo + CHUNK].reset_index(drop=True)
                out = part[[*names, "status"]].copy()
                for m in measured:
                    out[m] = np.full(len(part), np.nan)
                plans: list = [None] * len(part)
                ok = np.flatnonzero((part["status"] == "ok").to_numpy())
                if ok.size:
                    sub = part.iloc[ok]
                    a, b, active = _stack(sub["a"]), _stack(sub["b"]), _stack(sub["active"]) > 0
                    plan, settled = unbalanced_plans(a, b, active, sub["penalty"].to_numpy(dtype=float), cost)
                    av, bv = np.where(active, a, 0.0), np.where(active, b, 0.0)
                    total = plan.sum((1, 2))
                    d = np.maximum(av - plan.sum(2), 0.0).sum(1)
                    e = np.maximum(bv - plan.sum(1), 0.0).sum(1)
                    good = np.isfinite(total) & (total > 0) & settled
                    rows = ok[good]
                    values = {
                        "T": total, "D_pos": d, "B_pos": e, "d_rel": d / av.sum(1), "b_rel": e / bv.sum(1),
                        "M": (plan * cost).sum((1, 2)) / np.where(total > 0, total, 1.0),
                    }
                    for m, v in values.items():
                        out.loc[rows, m] = v[good]
                    out.loc[ok[~good], "status"] = "ERR_UOT_NUMERICAL"
                    if keep_plan:
                        for i, p in zip(rows, plan[good]):
                            plans[i] = p.ravel().tolist()
                out["plan"] = plans
                out = out.astype({m: object for m in measured}).where(out[measured].notna().reindex(columns=out.columns, fill_value=True), None)
                yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", status string, " + ", ".join(f"`{m}` double" for m in measured) + ", plan array<double>"
    return spread(screened).mapInPandas(run, schema)


def plan_rows(matched: DataFrame, keys: list[str], n_states: int) -> DataFrame:
    """Long plan (keys, i, j, mass) of the matched pairs."""
    rows = matched.where("status = 'ok'").select(*keys, F.posexplode("plan").alias("p", "mass"))
    return rows.select(*keys, F.floor(F.col("p") / n_states).cast("int").alias("i"), (F.col("p") % n_states).alias("j"), "mass")


def _on_grid(pairs: DataFrame, grid: list[float]) -> DataFrame:
    return pairs.withColumn("penalty", F.explode(F.array(*[F.lit(float(v)) for v in grid])))


def penalty_by_unmatched(pairs: DataFrame, scope: list[str], grid: list[float], cost: np.ndarray, target: float = 0.05) -> DataFrame:
    """Penalty whose median unmatched share is closest to the target."""
    matched = match_pairs(_on_grid(pairs, grid), cost, keep_plan=False).where("status = 'ok'")
    share = (F.col("B_pos") + F.col("D_pos")) / (F.col("T") + F.col("B_pos") + F.col("D_pos"))
    ranked = value_ranks(matched.select(*scope, "penalty", share.alias("share")), [*scope, "penalty"], "share", low=0.0, high=1.0)
    errors = ranked.groupBy(*scope, "penalty").agg(F.abs(at_quantile("share", 0.5) - target).alias("error"))
    return closest_candidate(errors, scope, "penalty", "error")


def penalty_by_mass(pairs: DataFrame, scope: list[str], grid: list[float], cost: np.ndarray) -> DataFrame:
    """Penalty whose mean matched mass is closest to the mean endpoint overlap; ties to the smaller value."""
    overlap = F.aggregate(F.zip_with("a", "b", lambda u, v: F.least(u, v)), F.lit(0.0), lambda s, v: s + v)
    goal = pairs.groupBy(*scope).agg(F.avg(overlap).alias("goal"))
    matched = match_pairs(_on_grid(pairs, grid), cost, keep_plan=False).where("status = 'ok'")
    reached = matched.groupBy(*scope, "penalty").agg(F.avg("T").alias("reached"))
    errors = reached.join(goal, scope).select(*scope, "penalty", F.abs(F.col("reached") - F.col("goal")).alias("error"))
    return closest_candidate(errors, scope, "penalty", "error")


# --- relation fitting --------------------------------------------------------
# Loss of the pairs under a relation and its gradient; the fit itself is in ``fitting``.

# Weights and start of the relation objective.
OFFDIAG_START = 1e-4
GEOMETRY_WEIGHT = 1e-2
COHORT_SCALE = 1e-2
SCALE_FLOOR = 1e-2
# Warm-up, then a rate that falls to nothing over the main steps; done after
# some steps in a row that no longer change a relation's objective.
WARMUP_STEPS, WARMUP_RATE = 20, 0.02
MAIN_STEPS, MAIN_RATE = 200, 0.05
MIN_MAIN_STEPS, PLATEAU_STEPS, PLATEAU_CHANGE = 100, 5, 1e-6


def start_relation(n_states: int) -> tuple[np.ndarray, np.ndarray]:
    """Identity with a little remodelling and a little open mass: [A | d] and e."""
    opened = min(0.05, 1.0 / (n_states + 1))
    t = np.full((n_states, n_states + 1), OFFDIAG_START)
    np.fill_diagonal(t, 1.0 - opened - (n_states - 1) * OFFDIAG_START)
    t[:, n_states] = opened
    return t, np.full(n_states, opened / n_states)


def _predict(q: np.ndarray, t: np.ndarray, e: np.ndarray):
    raw = (q @ t[:, :-1] if t.ndim == 2 else np.einsum("ni,nij->nj", q, t[:, :, :-1])) + e
    return raw, raw / raw.sum(1, keepdims=True)


#: Newton steps on the potentials of pairs that an update only moved a little, and damped ones where these fail.
NEWTON_STEPS, DAMPED_STEPS = 8, 40
#: Iterations before the last tries.
FIRST_ITER = 4
#: Potentials over epsilon further apart than this are left to the kernels in the log domain.
NEWTON_SPREAD = 200.0
#: States up to which a step is solved entry by entry for all pairs of a batch.
ELIMINATED_STATES = 8


def _newton_steps(kernel, u, w, mass, rest):
    """Newton steps of a batch in all potentials (over epsilon) but the last, which stays; arrays have their states first.

    The matrix is diag(mass) - U K diag(w) K' U without its last row and column.
    """
    k = len(u) - 1
    if k >= ELIMINATED_STATES:
        half = kernel[:k] * u[:k].T[:, :, None]
        slope = -(half * w.T[:, None, :]) @ half.transpose(0, 2, 1)
        slope[:, np.arange(k), np.arange(k)] += mass[:k].T
        return np.linalg.solve(slope, rest[:k].T[:, :, None])[:, :, 0].T
    at = [(i, j) for i in range(k) for j in range(i, k)]
    h = {}
    for (i, j), x in zip(at, np.array([kernel[i] * kernel[j] for i, j in at]) @ w):
        x *= u[i]
        x *= u[j]
        h[i, j] = mass[i] - x if i == j else -x
    y = [rest[i].copy() for i in range(k)]
    for i in range(k):
        h[i, i] = 1.0 / h[i, i]
        for j in range(i + 1, k):
            factor = h[i, j] * h[i, i]
            for m in range(j, k):
                h[j, m] -= factor * h[i, m]
            y[j] -= factor * y[i]
            h[i, j] = factor
        y[i] *= h[i, i]
    for i in range(k - 2, -1, -1):
        for j in range(i + 1, k):
            y[i] -= h[i, j] * y[j]
    return np.array(y)


def _newton(a, b, f, g, cost, eps, live, damped=False):
    """Newton steps on the dual of the live rows, written back where they reach the tolerance; the rows still live.

    The second potential is always the best answer to the first, so that a step solves for one
    side only. A row whose error does not halve is given back as it came; damped steps are
    halved instead until the dual value no longer falls.
    """
    if live.size == 0:
        return live
    kernel, closed = np.exp(-cost / eps), np.zeros(live.size, bool)
    x = f[live].T / eps
    on = np.flatnonzero((a[live] > 0).all(1) & (np.ptp(x, 0) < NEWTON_SPREAD))
    x = x[:, on] - x[:, on].max(0)
    al, bl = np.ascontiguousarray(a[live[on]].T), np.ascontiguousarray(b[live[on]].T)
    before, best = np.full(on.size, np.inf), np.full(on.size, -np.inf)
    last, step = x, np.zeros_like(x[:-1])
    with np.errstate(all="ignore"):
        for _ in range(1 + (DAMPED_STEPS if damped else NEWTON_STEPS)):
            if on.size == 0:
                break
            u = np.exp(x)
            columns = kernel.T @ u
            r = bl / columns
            mass = u * (kernel @ r)
            rest = al - mass
            error = np.abs(rest).max(0)
            done = error <= TOL
            if done.any():
                at = live[on[done]]
                closed[on[done]] = True
                f[at] = eps * x[:, done].T
                g[at] = np.where(bl[:, done] > 0, eps * np.log(r[:, done]), 0.0).T
            go = ~done if damped else ~done & (error <= 0.5 * before)
            if not go.all():
                on, before, best = on[go], before[go], best[go]
                al, bl, x, u, columns, r, mass, rest, error, last, step = (v[:, go] if v.ndim == 2 else v[go] for v in (al, bl, x, u, columns, r, mass, rest, error, last, step))
            before = error
            if not damped:
                x[:-1] += _newton_steps(kernel, u, r / columns, mass, rest)
                continue
            value = (al * x).sum(0) - (bl * np.log(columns)).sum(0)
            rises = value >= best - 1e-13
            last, best = np.where(rises, x, last), np.where(rises, value, best)
            step = np.where(rises, _newton_steps(kernel, u, r / columns, mass, rest), 0.5 * step)
            x = last.copy()
            x[:-1] += step
    return live[~closed]


def _tracked_potentials(a, b, cost, epsilons, start):
    """As ``balanced_potentials``, to the same tolerance, for potentials that an update only moved a little.

    Newton steps close nearly all rows; what they leave open takes the iterations, with a try
    after each absorption. Without a start the steps begin at zero, and the iterations of the
    rows they leave open at the first epsilon.
    """
    cold = start is None
    f, g = (np.zeros_like(a), np.zeros_like(b)) if cold else start
    eps, live = epsilons[-1], np.arange(a.shape[0])
    for damped in (True,) if cold else (False, True):
        live = _newton(a, b, f, g, cost, eps, live, damped)
    if cold and live.size:
        f[live], g[live] = balanced_potentials(a[live], b[live], cost, epsilons)
        return f, g
    for done in (0, *range(FIRST_ITER, MAX_ITER, ABSORB)):
        live = _scaled(a, b, f, g, cost, eps, min(ABSORB, MAX_ITER - done) if done else FIRST_ITER, TOL, live)
        live = _newton(a, b, f, g, cost, eps, live)
        if live.size == 0:
            break
    return f, g


def _pair_terms(q, b, own, t, e, cost, scale, warm=(None, None)):
    """Loss per pair and its gradient in the raw prediction; the dual potentials are the gradient in the prediction.

    ``own`` is the targets' self term; ``t`` and ``e`` are one relation or one per pair.
    """
    raw, p = _predict(q, t, e)
    epsilons = EPSILONS if warm[0] is None else EPSILONS[-1:]
    f, g = _tracked_potentials(p, b, cost, epsilons, warm[0])
    s, r = _tracked_potentials(p, p, cost, epsilons, warm[1])
    # dual value up to terms that cancel in the divergence
    loss = ((f * p).sum(1) + (g * b).sum(1) - 0.5 * ((s + r) * p).sum(1) - own) / scale
    dp = (f - 0.5 * (s + r)) / np.reshape(scale, (-1, 1))
    return loss, (dp - (dp * p).sum(1, keepdims=True)) / raw.sum(1, keepdims=True), ((f, g), (s, r))


def _pair_sums(q, w, loss, draw) -> np.ndarray:
    """Per pair what a step adds up: loss, squared loss, gradient and loss times gradient in A and e."""
    grad = np.hstack([(q[:, :, None] * draw[:, None, :]).reshape(len(q), -1), draw])
    return np.asarray(w)[:, None] * np.hstack([loss[:, None], loss[:, None] ** 2, grad, loss[:, None] * grad])


def _from_sums(sums: np.ndarray, k: int):
    """Mean loss plus its variance, and the gradient in [A | d] and e, per patient from its summed terms."""
    mean, square, grad = sums[:, 0], sums[:, 1], sums[:, 2:]
    grad, by_loss = grad[:, : k * k + k], grad[:, k * k + k :]
    grad = (1.0 - 2.0 * mean)[:, None] * grad + 2.0 * by_loss
    gt = np.zeros((len(sums), k, k + 1))
    gt[:, :, :-1] = grad[:, : k * k].reshape(-1, k, k)
    return mean + square - mean**2, gt, grad[:, k * k :]


def _step_gradient(q, b, w, t, e, cost, scale, warm):
    """Loss and its gradient in [A | d] and e of one patient with all its pairs at hand."""
    loss, draw, (cross, own) = _pair_terms(q, b, warm[2], t, e, cost, scale, warm)
    fit, gt, ge = _from_sums(_pair_sums(q, w, loss, draw).sum(0)[None], e.size)
    return fit[0], gt[0], ge[0], (cross, own, warm[2])
