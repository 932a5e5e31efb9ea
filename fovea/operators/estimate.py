"""Closed-form relation estimators and cohort templates.

Vectors over the states travel as arrays, one row per patient or per source
state, so most formulas are row-local and only cohort averages shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.functions.ranks import at_quantile, value_ranks
from fovea.runtime import durable
from fovea.schema import COORD, MASS_TOL, REL_PATIENT


def vsum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def endpoint_vectors(vectors: DataFrame, sides: DataFrame, n_states: int) -> DataFrame:
    """Mean source vector ``x`` and target vector ``y`` of every eligible patient."""
    rows = vectors.join(sides, ["timepoint", "domain_label"])

    def mean(side: str) -> Column:
        chosen = F.col("side") == side
        return F.array(*[F.avg(F.when(chosen, F.get("fractions", F.lit(k)))) for k in range(n_states)])

    means = rows.groupBy(*REL_PATIENT).agg(mean("source").alias("x"), mean("target").alias("y"))
    return means.where(F.get("x", F.lit(0)).isNotNull() & F.get("y", F.lit(0)).isNotNull())


def endpoints_long(endpoints: DataFrame) -> DataFrame:
    keys = [c for c in endpoints.columns if c not in ("x", "y")]
    return endpoints.select(*keys, F.posexplode(F.arrays_zip("x", "y")).alias("state_id", "p")).select(
        *keys, "state_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def diagonal_plan(endpoints: DataFrame) -> DataFrame:
    """Matched plan that only keeps mass in place: ``min(x_i, y_i)``."""
    long = endpoints_long(endpoints)
    keys = [c for c in long.columns if c not in ("state_id", "x", "y")]
    return long.select(*keys, F.col("state_id").alias("i"), F.col("state_id").alias("j"), F.least("x", "y").alias("mass"))


def relation_rows(keys: list[str], rows: DataFrame, n_states: int) -> DataFrame:
    """Long relation entries from rows (state_id, a array, d, e); no shuffle.

    A sits at (i, j), d at (i, K) and e at (K, j), the augmented coordinates.
    """
    k = F.lit(n_states)
    own = F.array(
        F.struct(F.lit("d").alias("entry_type"), F.col("state_id").alias("row_id"), k.alias("col_id"), F.col("d").alias("value")),
        F.struct(F.lit("e").alias("entry_type"), k.alias("row_id"), F.col("state_id").alias("col_id"), F.col("e").alias("value")),
    )
    matched = F.transform(
        "a",
        lambda v, j: F.struct(
            F.lit("A").alias("entry_type"), F.col("state_id").alias("row_id"), j.alias("col_id"), v.alias("value")
        ),
    )
    return rows.select(*keys, F.inline(F.concat(matched, own)))


def relation_from_plan(endpoints: DataFrame, plan: DataFrame, n_states: int, tol: float = MASS_TOL) -> DataFrame:
    """``A = P/x``, ``d = max((x - r)/x, 0)``, ``e = max(y - c, 0)``; empty source rows stay zero."""
    keys = [c for c in endpoints.columns if c not in ("x", "y")]
    long = endpoints_long(endpoints)
    by_row = plan.groupBy(*keys, F.col("i").alias("state_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("j", "mass"))).alias("p"), F.sum("mass").alias("r")
    )
    by_col = plan.groupBy(*keys, F.col("j").alias("state_id")).agg(F.sum("mass").alias("c"))
    joined = long.join(by_row, [*keys, "state_id"], "left").join(by_col, [*keys, "state_id"], "left")
    x, r = F.col("x"), F.coalesce("r", F.lit(0.0))
    live = x > tol
    axis = F.sequence(F.lit(0), F.lit(n_states - 1))
    rows = joined.select(
        *keys,
        "state_id",
        F.transform(axis, lambda j: F.when(live, F.coalesce(F.try_element_at("p", j), F.lit(0.0)) / x).otherwise(0.0)).alias("a"),
        F.when(live, F.greatest((x - r) / x, F.lit(0.0))).otherwise(0.0).alias("d"),
        F.greatest(F.col("y") - F.coalesce("c", F.lit(0.0)), F.lit(0.0)).alias("e"),
    )
    return relation_rows(keys, rows, n_states)


def diagonal_relation(endpoints: DataFrame, n_states: int, tol: float = MASS_TOL) -> DataFrame:
    """The relation of the diagonal plan, row by row without joins."""
    keys = [c for c in endpoints.columns if c not in ("x", "y")]
    long = endpoints_long(endpoints)
    x, kept = F.col("x"), F.least("x", "y")
    live = x > tol
    axis = F.sequence(F.lit(0), F.lit(n_states - 1))
    rows = long.select(
        *keys,
        "state_id",
        F.transform(axis, lambda j: F.when(live & (j == F.col("state_id")), kept / x).otherwise(0.0)).alias("a"),
        F.when(live, F.greatest((x - kept) / x, F.lit(0.0))).otherwise(0.0).alias("d"),
        F.greatest(F.col("y") - kept, F.lit(0.0)).alias("e"),
    )
    return relation_rows(keys, rows, n_states)


def cost_rows(cost: DataFrame) -> DataFrame:
    """State-sized cost matrix with one array per row."""
    ordered = F.array_sort(F.collect_list(F.struct("j", "cost")))
    return cost.groupBy(F.col("i").alias("state_id")).agg(F.transform(ordered, lambda s: s["cost"]).alias("cost"))


def gated_templates(endpoints: DataFrame, cost: DataFrame, tau: float = 2.0, tol: float = MASS_TOL) -> DataFrame:
    """Gated residual templates, one row per patient and state.

    Shared mass stays on the diagonal. Surplus ``r-`` meets shortage ``r+`` in
    proportion, damped by ``exp(-cost/tau)``; what is damped away opens ``d`` on
    the source side and ``v`` on the target side. The cost is symmetric, so a
    row of it also serves as the column needed for ``v``.
    """
    keys = [c for c in endpoints.columns if c not in ("x", "y")]
    unit = lambda v: F.transform(v, lambda t: t / vsum(v))
    base = endpoints.select(*keys, unit(F.col("x")).alias("xs"), unit(F.col("y")).alias("ys"))
    gaps = base.select(
        "*",
        F.zip_with("xs", "ys", lambda a, b: F.greatest(a - b, F.lit(0.0))).alias("minus"),
        F.zip_with("xs", "ys", lambda a, b: F.greatest(b - a, F.lit(0.0))).alias("plus"),
    ).withColumn("rho", vsum(F.col("minus")))
    rows = gaps.select(*keys, "ys", "minus", "plus", "rho", F.posexplode("xs").alias("state_id", "xi"))
    gated = rows.join(F.broadcast(cost_rows(cost)), "state_id")
    here = F.col("state_id")
    gate = F.transform("cost", lambda c, j: F.when(j == here, F.lit(0.0)).otherwise(F.exp(-c / F.lit(tau))))
    moved_out = F.zip_with(F.col("gate"), F.col("plus"), lambda g, p: g * F.get("minus", here) * p / F.col("rho"))
    moved_in = F.zip_with(F.col("gate"), F.col("minus"), lambda g, m: g * m * F.get("plus", here) / F.col("rho"))
    stays = F.least(F.col("xi"), F.get("ys", here))
    identified = F.col("xi") > tol
    flat = F.col("rho") <= tol
    out = gated.withColumn("gate", gate).withColumn("out", moved_out).withColumn("into", moved_in)
    kept = F.transform("out", lambda v, j: F.when(j == here, stays).otherwise(v) / F.col("xi"))
    still = F.transform("out", lambda v, j: F.when(j == here, 1.0).otherwise(0.0))
    nothing = F.transform("out", lambda v: F.lit(0.0))
    clip = lambda v: F.greatest(v, F.lit(0.0))
    return out.select(
        *keys,
        "state_id",
        F.col("xi").alias("x"),
        F.get("ys", here).alias("y"),
        F.when(flat, still).when(identified, kept).otherwise(nothing).alias("a"),
        F.when(flat | ~identified, 0.0).otherwise(clip(F.get("minus", here) - vsum(F.col("out"))) / F.col("xi")).alias("d"),
        F.when(flat, 0.0).otherwise(clip(F.get("plus", here) - vsum(F.col("into")))).alias("e"),
        identified.alias("identified"),
    )


def pooled_rows(templates: DataFrame, scope: list[str], n_states: int, tol: float = MASS_TOL) -> DataFrame:
    """Source-weighted cohort row per state, rescaled to the simplex; identity when nobody shows the state."""
    w = F.when(F.col("identified"), F.col("x"))
    sums = templates.groupBy(*scope, "state_id").agg(
        F.coalesce(F.sum(w), F.lit(0.0)).alias("w"),
        F.array(*[F.coalesce(F.sum(w * F.get("a", F.lit(k))), F.lit(0.0)) for k in range(n_states)]).alias("wa"),
        F.coalesce(F.sum(w * F.col("d")), F.lit(0.0)).alias("wd"),
    )
    means = sums.select(
        *scope, "state_id", "w",
        F.transform("wa", lambda v: v / F.when(F.col("w") > tol, F.col("w"))).alias("a"),
        (F.col("wd") / F.when(F.col("w") > tol, F.col("w"))).alias("d"),
    ).withColumn("total", vsum(F.col("a")) + F.col("d"))
    fallback = F.transform(F.sequence(F.lit(0), F.lit(n_states - 1)), lambda j: F.when(j == F.col("state_id"), 1.0).otherwise(0.0))
    known = (F.col("w") > tol) & (F.col("total") > tol)
    return means.select(
        *scope,
        "state_id",
        F.when(known, F.transform("a", lambda v: v / F.col("total"))).otherwise(fallback).alias("pooled_a"),
        F.when(known, F.col("d") / F.col("total")).otherwise(0.0).alias("pooled_d"),
    )


def filled_templates(templates: DataFrame, scope: list[str], n_states: int) -> DataFrame:
    """Templates whose unseen rows take the pooled cohort row."""
    pooled = pooled_rows(templates, scope, n_states)
    return templates.join(pooled, [*scope, "state_id"]).select(
        *[c for c in templates.columns if c not in ("a", "d")],
        F.when(F.col("identified"), F.col("a")).otherwise(F.col("pooled_a")).alias("a"),
        F.when(F.col("identified"), F.col("d")).otherwise(F.col("pooled_d")).alias("d"),
    )


def open_profiles(templates: DataFrame, scope: list[str], n_states: int, tol: float = MASS_TOL) -> DataFrame:
    """Where new mass appears: each patient's normalised open target, else the cohort's, else uniform."""
    cohort = templates.groupBy(*scope, "state_id").agg(F.sum("e").alias("all_e"))
    cohort_total = cohort.groupBy(*scope).agg(F.sum("all_e").alias("sum_e"))
    shared = cohort.join(cohort_total, scope).select(
        *scope, "state_id",
        F.when(F.col("sum_e") > tol, F.col("all_e") / F.col("sum_e")).otherwise(1.0 / n_states).alias("shared"),
    )
    own = templates.groupBy(*scope, "patient_id").agg(F.sum("e").alias("own_e"))
    return (
        templates.join(own, [*scope, "patient_id"])
        .join(shared, [*scope, "state_id"])
        .select(
            *scope, "patient_id", "state_id",
            F.when(F.col("own_e") > tol, F.col("e") / F.col("own_e")).otherwise(F.col("shared")).alias("open_share"),
        )
    )


def template_entries(templates: DataFrame, n_states: int) -> DataFrame:
    keys = [c for c in templates.columns if c not in ("state_id", "x", "y", "a", "d", "e", "identified")]
    return relation_rows(keys, templates, n_states)


def medoid_distances(entries: DataFrame, scope: list[str]) -> DataFrame:
    """Summed L1 distance of every patient to all others, without forming pairs.

    Per coordinate, the distances to all other values follow from the sorted
    prefix sums: ``v (2 below - n) + sum_all - 2 sum_below``.
    """
    stable = durable(entries)
    ranked = value_ranks(stable, [*scope, *COORD], "value", low=0.0, high=1.0)
    v = F.col("value")
    spread = ranked.select(
        *scope, *COORD, "value",
        (v * (2 * F.col("below") - F.col("n")) + F.col("sum_all") - 2 * F.col("sum_below")).alias("l1"),
    )
    return stable.join(spread, [*scope, *COORD, "value"]).groupBy(*scope, "patient_id").agg(F.sum("l1").alias("distance"))


def medoid(entries: DataFrame, scope: list[str]) -> DataFrame:
    """Patient with the smallest summed distance; ties (at nine decimals) to the first id."""
    d = medoid_distances(entries, scope)
    best = d.groupBy(*scope).agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "patient_id")).alias("b"))
    return best.select(*scope, F.col("b.patient_id").alias("patient_id"), F.col("b.distance").alias("distance"))


def endpoint_overlap(endpoints: DataFrame) -> DataFrame:
    keys = [c for c in endpoints.columns if c not in ("x", "y")]
    return endpoints.select(*keys, vsum(F.zip_with("x", "y", lambda a, b: F.least(a, b))).alias("overlap"))


def matched_budget(overlaps: DataFrame, scope: list[str]) -> DataFrame:
    return overlaps.groupBy(*scope).agg(F.avg("overlap").alias("matched_mass_budget"), F.count(F.lit(1)).alias("n_pairs"))


def active_support(pairs: DataFrame, n_min: float) -> DataFrame:
    """States of a pair with enough combined mass, and the share of mass pruned away."""
    both = F.zip_with("a", "b", lambda u, v: u + v)
    total, cut = vsum(F.col("both")), vsum(F.transform("both", lambda v: F.when(v < n_min, v).otherwise(0.0)))
    return pairs.withColumn("both", both).select(
        *pairs.columns,
        F.transform("both", lambda v: v >= n_min).alias("active"),
        F.when(total > 0, cut / total).otherwise(0.0).alias("mass_pruned_ratio"),
    )


def screen_pairs(pairs: DataFrame, n_min: float) -> DataFrame:
    """Status of each pair before matching; earlier reasons win."""
    kept = lambda c: vsum(F.zip_with(F.col(c), F.col("active"), lambda v, k: F.when(k, v).otherwise(0.0)))
    a, b = vsum(F.col("a")), vsum(F.col("b"))
    broken = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    status = (
        F.when(broken(a) | broken(b), "ERR_UOT_NUMERICAL")
        .when(a <= 0, "ERR_UOT_EMPTY_MASS_SOURCE")
        .when(b <= 0, "ERR_UOT_EMPTY_MASS_TARGET")
        .when(~F.exists("active", lambda k: k) | (kept("a") <= 0) | (kept("b") <= 0), "ERR_UOT_EMPTY_SUPPORT")
        .otherwise("ok")
    )
    return active_support(pairs, n_min).withColumn("status", status)


def plan_metrics(plan: DataFrame, masses: DataFrame, cost: DataFrame, tau: float, keys: list[str]) -> DataFrame:
    """Matched mass, unmatched masses, mean cost and share moved at low cost, from a long plan.

    ``masses`` holds (keys, state_id, x, y); ``cost`` is state-sized.
    """
    costed = plan.join(F.broadcast(cost.select("i", "j", "cost")), ["i", "j"])
    by_row = costed.groupBy(*keys, F.col("i").alias("state_id")).agg(
        F.sum("mass").alias("r"),
        F.sum(F.col("mass") * F.col("cost")).alias("rc"),
        F.sum(F.when(F.col("cost") <= tau, F.col("mass")).otherwise(0.0)).alias("rt"),
    )
    by_col = plan.groupBy(*keys, F.col("j").alias("state_id")).agg(F.sum("mass").alias("c"))
    joined = masses.join(by_row, [*keys, "state_id"], "left").join(by_col, [*keys, "state_id"], "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    totals = joined.groupBy(*keys).agg(
        F.sum(zero("r")).alias("T"),
        F.sum(F.greatest(F.col("x") - zero("r"), F.lit(0.0))).alias("D_pos"),
        F.sum(F.greatest(F.col("y") - zero("c"), F.lit(0.0))).alias("B_pos"),
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum(zero("rc")).alias("tc"),
        F.sum(zero("rt")).alias("tt"),
    )
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return totals.select(
        *keys, "T", "D_pos", "B_pos",
        ratio("D_pos", "sx").alias("d_rel"), ratio("B_pos", "sy").alias("b_rel"),
        ratio("tc", "T").alias("M"), ratio("tt", "T").alias("R"),
    )


def predict_targets(vectors: DataFrame, entries: DataFrame, keys: list[str], n_states: int) -> DataFrame:
    """``normalize(q A + e)`` per FOV; ``vectors`` has (keys, fov columns, fractions)."""
    packed = pack_relations(entries, keys, n_states)
    axis = F.sequence(F.lit(0), F.lit(n_states - 1))
    raw = F.transform(
        axis,
        lambda j: vsum(F.zip_with(F.col("fractions"), F.col("A"), lambda q, row: q * F.get(row, j))) + F.get("e", j),
    )
    return vectors.join(packed, keys).withColumn("raw", raw).select(
        *vectors.columns, F.transform("raw", lambda v: v / F.when(vsum(F.col("raw")) > 0, vsum(F.col("raw")))).alias("predicted")
    )


def pack_relations(entries: DataFrame, keys: list[str], n_states: int) -> DataFrame:
    """One row per relation with arrays ``A`` (K x K), ``d`` and ``e``; state-sized lists only."""

    def listed(kind: str, *order: str) -> Column:
        items = F.collect_list(F.when(F.col("entry_type") == kind, F.struct(*order, "value")))
        return F.transform(F.array_sort(items), lambda s: s["value"])

    flat = entries.groupBy(*keys).agg(
        listed("A", "row_id", "col_id").alias("flat"), listed("d", "row_id").alias("d"), listed("e", "col_id").alias("e")
    )
    axis = F.sequence(F.lit(0), F.lit(n_states - 1))
    return flat.select(*keys, F.transform(axis, lambda i: F.slice("flat", i * n_states + 1, n_states)).alias("A"), "d", "e")


def marginals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """``mu- = rowsum(A) + d`` and ``mu+ = colsum(A) + e``."""
    is_e = F.col("entry_type") == "e"
    is_a = F.col("entry_type") == "A"
    parts = F.array(
        F.struct(F.when(~is_e, F.col("row_id")).alias("state_id"), F.col("value").alias("minus"), F.lit(0.0).alias("plus")),
        F.struct(F.when(is_a | is_e, F.col("col_id")).alias("state_id"), F.lit(0.0).alias("minus"), F.col("value").alias("plus")),
    )
    return (
        entries.select(*keys, F.inline(F.filter(parts, lambda p: p["state_id"].isNotNull())))
        .groupBy(*keys, "state_id")
        .agg(F.sum("minus").alias("mu_minus"), F.sum("plus").alias("mu_plus"))
    )


def conditional_kernel(entries: DataFrame, keys: list[str], n_states: int) -> DataFrame:
    """``R = A / (1 - d)`` where something is left to match, else null."""
    packed = pack_relations(entries, keys, n_states)
    rows = packed.select(*keys, "d", F.posexplode("A").alias("row_id", "a"))
    left = F.lit(1.0) - F.get("d", F.col("row_id"))
    cells = F.transform("a", lambda v: v / F.when(left > 0, left))
    return rows.select(*keys, "row_id", F.posexplode(cells).alias("col_id", "probability"))


def cohort_template(entries: DataFrame) -> DataFrame:
    """Mean of every entry over the patients of a relation."""
    return entries.groupBy("relation_id", *COORD).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_patients")
    )


def cohort_summary(entries: DataFrame, n_states: int) -> DataFrame:
    """Support and dispersion: mean squared deviation of relation rows plus that of e."""
    per_entry = entries.groupBy("relation_id", *COORD).agg(
        F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    return per_entry.groupBy("relation_id").agg(
        F.max("n").alias("support_n_patients"), (F.sum("v") / n_states).alias("dispersion")
    )


# Weights of the objective ledger.
WITHIN_PATIENT_WEIGHT = 1.0
GEOMETRY_WEIGHT = 1e-2
COHORT_SCALE = 1e-2


def objective_ledger(
    block_losses: DataFrame, entries: DataFrame, cost: DataFrame, obs_scale: float, cost_scale: float, n_states: int,
    geometry_scale: float = 1.0,
) -> DataFrame:
    """Loss components per relation from block losses (relation, patient, loss) and entries."""
    per_patient = block_losses.groupBy(*REL_PATIENT).agg(
        F.avg("loss").alias("m"), F.var_pop(F.col("loss") / obs_scale).alias("v")
    )
    fit = per_patient.groupBy("relation_id").agg(
        F.avg("m").alias("observation_raw"), F.avg("v").alias("within_patient")
    )
    is_a = F.col("entry_type") == "A"
    costed = entries.join(
        F.broadcast(cost.select(F.col("i").alias("row_id"), F.col("j").alias("col_id"), F.col("cost"))), ["row_id", "col_id"], "left"
    )
    prior = costed.groupBy("relation_id").agg(
        (F.avg(F.when(F.col("entry_type") == "d", F.col("value"))) + F.avg(F.when(F.col("entry_type") == "e", F.col("value")))).alias("open"),
        (F.sum(F.when(is_a, F.col("value") * F.col("cost"))) / cost_scale).alias("moved"),
        (F.count_if(F.col("entry_type") == "d") / n_states).alias("p"),
    )
    joined = fit.join(prior, "relation_id").join(cohort_summary(entries, n_states), "relation_id")
    parts = joined.select(
        "relation_id",
        "observation_raw",
        (F.col("observation_raw") / obs_scale).alias("observation"),
        "within_patient",
        F.col("open").alias("open_loss"),
        (F.col("moved") / n_states / F.col("p") / geometry_scale).alias("geometry"),
        F.col("dispersion").alias("recurrence"),
    )
    return parts.select("*", _total_loss().alias("total"))


def _total_loss() -> Column:
    fit = F.col("observation") + WITHIN_PATIENT_WEIGHT * F.col("within_patient")
    prior = (F.col("open_loss") + GEOMETRY_WEIGHT * F.col("geometry")) / 2
    return (fit + prior + F.col("recurrence") / COHORT_SCALE) / 3


def block_scales(pair_costs: DataFrame, keys: list[str]) -> DataFrame:
    """Median positive finite pair cost per block; 1.0 and a flag when there is none.

    A block holds the pairs of one FOV with a share of the other bag, but that
    share may still be large, so the median is taken from distributed ranks.
    """
    c = F.col("cost")
    positive = pair_costs.where(c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf")))
    ranked = value_ranks(positive, keys, "cost", low=0.0, high=2.0)

    medians = ranked.groupBy(*keys).agg(at_quantile("cost", 0.5).alias("m"))
    blocks = pair_costs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))
    return blocks.join(medians, keys, "left").select(
        *keys, "n_pairs", F.coalesce("m", F.lit(1.0)).alias("scale"), F.col("m").isNull().alias("scale_defaulted")
    )


def closest_candidate(errors: DataFrame, scope: list[str], candidate: str, error: str) -> DataFrame:
    """Grid candidate with the smallest error, ties to the smaller value, with a boundary flag."""
    best = errors.groupBy(*scope).agg(
        F.min(F.struct(error, candidate)).alias("b"), F.min(candidate).alias("lo"), F.max(candidate).alias("hi")
    )
    chosen = F.col(f"b.{candidate}")
    return best.select(
        *scope, chosen.alias(f"selected_{candidate}"), F.col(f"b.{error}").alias(error),
        ((chosen == F.col("lo")) | (chosen == F.col("hi"))).alias("boundary_hit"),
    )
