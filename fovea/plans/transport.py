"""Catalog: transport kernels and fitted relations (checked by rows and by unit tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import bags, estimate, fitting, kernels, pairing
from fovea.plans import base
from fovea.plans import relations as rel
from fovea.plans.base import K
from fovea.plans.catalog import query, view
from fovea.runtime import literal_table, staged

RK = ["relation_id", "patient_id"]
GRID = [0.25, 0.5, 1.0, 2.0, 4.0]


def pairs(spark, sf):
    """FOV pairs of the evidence blocks with their composition arrays."""
    build = lambda: pairing.block_pairs(rel.blocks(spark, sf), base.fov_vectors(spark, sf))
    return staged(spark, "pairs", sf, build)


def cost(spark, sf):
    return kernels.cost_array(rel.identity_cost(spark, sf), K)


def fitted(spark, sf):
    """(relation entries, ledger) of all declared relations, from one fit."""
    made = []

    def fit():
        if not made:
            made.append(fitting.fit_relations(pairs(spark, sf), cost(spark, sf), K))
        return made[0]

    return staged(spark, "fit_entries", sf, lambda: fit().entries), staged(spark, "fit_ledger", sf, lambda: fit().ledger)


view(
    "block_pairs",
    "SELECT a.relation_id, a.patient_id, a.subbag_index, a.fov_id AS source_fov_id, b.fov_id AS target_fov_id FROM (SELECT * FROM blocks WHERE side = 'source') a JOIN (SELECT * FROM blocks WHERE side = 'target') b USING (relation_id, patient_id, subbag_index)",
    "blocks",
)


@query(
    "block_pairs", "F6 F7",
    "SELECT p.relation_id, p.patient_id, p.subbag_index, p.source_fov_id, p.target_fov_id, sum(abs(c.fraction - d.fraction)) AS l1 FROM block_pairs p JOIN comp c ON c.patient_id = p.patient_id AND c.fov_id = p.source_fov_id AND c.timepoint = 'pre' JOIN comp d ON d.patient_id = p.patient_id AND d.fov_id = p.target_fov_id AND d.timepoint = 'post' AND d.state_id = c.state_id GROUP BY ALL",
    "block_pairs comp", "l1",
)
def _(spark, sf):
    l1 = estimate.vsum(F.zip_with("a", "b", lambda u, v: F.abs(u - v)))
    return pairs(spark, sf).select(*RK, "subbag_index", "source_fov_id", "target_fov_id", l1.alias("l1"))


@query("pair_divergences", "G13")
def _(spark, sf):
    rows = pairs(spark, sf).select(*RK, "subbag_index", "source_fov_id", "target_fov_id", "a", "b")
    return kernels.pair_divergences(rows, cost(spark, sf))


@query("block_divergences", "G13 G15")
def _(spark, sf):
    rows = pairs(spark, sf).select(*RK, "subbag_index", "pair_id", "a", "b")
    costs = staged(spark, "pair_costs", sf, lambda: kernels.pair_divergences(rows, cost(spark, sf)))
    scales = estimate.block_scales(costs, [*RK, "subbag_index"])
    return kernels.block_divergences(costs).join(scales.drop("n_pairs"), [*RK, "subbag_index"])


def block_bags(spark, sf):
    """FOVs of both sides of the evidence blocks with their compositions."""
    rows = rel.blocks(spark, sf).join(base.fov_vectors(spark, sf).drop("domain_label"), ["patient_id", "timepoint", "fov_id"])
    return rows.select(*RK, "subbag_index", "side", "fov_id", "fractions")


@query("bag_divergences", "G13 G15")
def _(spark, sf):
    return bags.bag_divergences(block_bags(spark, sf), [*RK, "subbag_index"], cost(spark, sf))


@query(
    "bag_divergence_checks", "G13",
    """SELECT relation_id, patient_id, subbag_index, count(*) FILTER (side = 'source') AS n_source, count(*) FILTER (side = 'target') AS n_target, true AS sound, true AS zero_against_itself
       FROM blocks GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 'source') > 0 AND count(*) FILTER (side = 'target') > 0""", "blocks",
)
def _(spark, sf):
    """Every block has a finite divergence, of one between two different single FOVs; a bag has none against itself."""
    key, both = [*RK, "subbag_index"], block_bags(spark, sf)
    out = bags.bag_divergences(both, key, cost(spark, sf))
    source = both.where("side = 'source'")
    same = bags.bag_divergences(source.unionByName(source.withColumn("side", F.lit("target"))), key, cost(spark, sf)).select(*key, F.col("divergence").alias("own"))
    single = (F.col("n_source") == 1) & (F.col("n_target") == 1) & ~F.col("scale_defaulted")
    sound = (F.col("status") == "ok") & (F.col("divergence") >= 0) & (~single | (F.abs(F.col("divergence") - 1) < 1e-6))
    return out.join(same, key).select(*key, "n_source", "n_target", sound.alias("sound"), (F.col("own") < 1e-6).alias("zero_against_itself"))


@query("match_pairs", "G14")
def _(spark, sf):
    rows = pairs(spark, sf).select(*RK, "subbag_index", "source_fov_id", "target_fov_id", "a", "b").withColumn("penalty", F.lit(1.0))
    return kernels.match_pairs(rows, cost(spark, sf), keep_plan=False).drop("plan")


@query("matched_relations", "G14 G3")
def _(spark, sf):
    ep = rel.endpoints(spark, sf)
    rows = ep.select(*RK, F.col("x").alias("a"), F.col("y").alias("b")).withColumn("penalty", F.lit(1.0))
    plan = kernels.plan_rows(kernels.match_pairs(rows, cost(spark, sf)), RK, K)
    return estimate.relation_from_plan(ep, plan, K)


@query("penalty_by_unmatched", "G11")
def _(spark, sf):
    rows = rel.endpoints(spark, sf).select(*RK, F.col("x").alias("a"), F.col("y").alias("b"))
    return kernels.penalty_by_unmatched(rows, ["relation_id"], GRID, cost(spark, sf))


@query("penalty_by_mass", "G12")
def _(spark, sf):
    rows = rel.endpoints(spark, sf).select(*RK, F.col("x").alias("a"), F.col("y").alias("b"))
    return kernels.penalty_by_mass(rows, ["relation_id"], GRID, cost(spark, sf))


@query(
    "closest_candidates", "G11 G12",
    """SELECT relation_id, selected_candidate, error, selected_candidate IN (0, 4) AS boundary_hit FROM (SELECT relation_id, row_id AS selected_candidate, abs(value - 0.05) AS error,
       row_number() OVER (PARTITION BY relation_id ORDER BY abs(value - 0.05), row_id) AS rn FROM cohort WHERE entry_type = 'd') WHERE rn = 1""",
    "cohort", "error",
)
def _(spark, sf):
    d = estimate.cohort_template(rel.gated(spark, sf)).where("entry_type = 'd'")
    errors = d.select("relation_id", F.col("row_id").alias("candidate"), F.abs(F.col("value") - 0.05).alias("error"))
    return estimate.closest_candidate(errors, ["relation_id"], "candidate", "error")


@query("fitted_relations", "G17 G18")
def _(spark, sf):
    return fitted(spark, sf)[0]


@query(
    "fit_ledger", "G16 G17",
    "SELECT relation_id, patient_id, 'ok' AS status, count(*) AS n_pairs, true AS adds_up FROM block_pairs GROUP BY 1, 2", "block_pairs",
)
def _(spark, sf):
    """Status and terms of the objective per patient; the objective recomputed from relation, mean and observation."""
    entries, ledger = fitted(spark, sf)
    opened = entries.where("entry_type <> 'A'").groupBy(*RK).agg((F.sum("value") / K).alias("open_now"))
    mean = entries.groupBy("relation_id", "entry_type", "row_id", "col_id").agg(F.avg("value").alias("mean"))
    apart = entries.join(mean, ["relation_id", "entry_type", "row_id", "col_id"]).groupBy(*RK).agg((F.sum((F.col("value") - F.col("mean")) ** 2) / K).alias("apart_now"))
    moved = entries.where("entry_type = 'A'").join(rel.identity_cost(spark, sf).select(F.col("i").alias("row_id"), F.col("j").alias("col_id"), "cost"), ["row_id", "col_id"])
    geometry = moved.groupBy(*RK).agg((F.sum(F.col("value") * F.col("cost")) / K).alias("geometry_now"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9
    again = (F.col("observation") + F.col("consistency") + (F.col("open_now") + kernels.GEOMETRY_WEIGHT * F.col("geometry_now")) / 2 + F.col("apart_now") / kernels.COHORT_SCALE) / 3
    rows = ledger.join(opened, RK).join(apart, RK).join(geometry, RK)
    sound = near("open", "open_now") & near("geometry", "geometry_now") & near("recurrence", "apart_now") & (F.abs(F.col("objective") - again) <= 1e-6)
    return rows.select(*RK, "status", "n_pairs", sound.alias("adds_up"))


# --- checks of fitted results ---------------------------------------------------
# The fits themselves are outside SQL. What must hold for them is not: who is fitted,
# that rows are distributions, that a reported figure follows from the reported values.


@query(
    "fitted_relation_checks", "G17",
    f"""SELECT relation_id, patient_id, {K * (K + 2)} AS n_entries, true AS within_bounds, true AS rows_sum_to_one, true AS closer_than_start
        FROM support WHERE status = 'eligible'""",
    "support",
)
def _(spark, sf):
    """Every eligible patient has a full relation of row distributions that predicts its blocks better than the start does."""
    entries = fitted(spark, sf)[0]
    row = F.when(F.col("entry_type") != "e", F.col("row_id"))
    sums = entries.where("entry_type <> 'e'").groupBy(*RK, row.alias("row_id")).agg(F.sum("value").alias("s"))
    whole = sums.groupBy(*RK).agg(F.bool_and(F.abs(F.col("s") - 1) < 1e-8).alias("rows_sum_to_one"))
    facts = entries.groupBy(*RK).agg(
        F.count(F.lit(1)).cast("int").alias("n_entries"), F.bool_and(F.col("value").between(0, 1 + 1e-9)).alias("within_bounds")
    )
    start, opened = kernels.start_relation(K)
    flat = lambda kind, i, j, v: (kind, i, j, float(v))
    first = [flat("A" if j < K else "d", i, j, start[i, j]) for i in range(K) for j in range(K + 1)] + [flat("e", K, j, opened[j]) for j in range(K)]
    begun = entries.select(*RK).distinct().crossJoin(F.broadcast(literal_table(spark, ["entry_type", "row_id", "col_id", "value"], first)))

    def gap(relation, name):
        rows = pairs(spark, sf).select(*RK, "pair_id", F.col("a").alias("fractions"), "b")
        predicted = estimate.predict_targets(rows.select(*RK, "pair_id", "fractions"), relation, RK, K).select("pair_id", "predicted")
        off = F.aggregate(F.zip_with("predicted", "b", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v)
        return rows.join(predicted, "pair_id").groupBy("relation_id").agg(F.avg(off).alias(name))

    better = gap(entries, "now").join(gap(begun, "then"), "relation_id").select("relation_id", (F.col("now") <= F.col("then") + 1e-6).alias("closer_than_start"))
    return facts.join(whole, RK).join(better, "relation_id")


@query(
    "match_checks", "G14",
    """SELECT relation_id, patient_id, subbag_index, source_fov_id, target_fov_id, true AS known_status, true AS mass_adds_up FROM block_pairs""", "block_pairs",
)
def _(spark, sf):
    """Every pair comes back, and its matched and unmatched mass make up the endpoint mass."""
    rows = pairs(spark, sf).select(*RK, "subbag_index", "source_fov_id", "target_fov_id", "a", "b").withColumn("penalty", F.lit(1.0))
    out = kernels.match_pairs(rows, cost(spark, sf), keep_plan=False)
    ok = F.col("status") == "ok"
    # unmatched mass is cut at zero, so matched plus unmatched is at least one side's mass of one
    adds = (F.col("T") + F.col("D_pos") >= 1 - 1e-6) & (F.col("T") + F.col("B_pos") >= 1 - 1e-6) & F.col("M").between(0, 1e6)
    return out.select(
        *RK, "subbag_index", "source_fov_id", "target_fov_id",
        (ok | F.col("status").startswith("ERR_UOT")).alias("known_status"), F.when(ok, adds).otherwise(True).alias("mass_adds_up"),
    )


@query(
    "divergence_checks", "G13",
    "SELECT relation_id, patient_id, subbag_index, source_fov_id, target_fov_id, true AS sound, true AS zero_when_equal FROM block_pairs", "block_pairs",
)
def _(spark, sf):
    """Every pair has a finite divergence of at least zero, and of zero between equal compositions."""
    keys = [*RK, "subbag_index", "source_fov_id", "target_fov_id"]
    rows = pairs(spark, sf).select(*keys, "a", "b")
    out = kernels.pair_divergences(rows, cost(spark, sf))
    same = kernels.pair_divergences(rows.select(*keys, "a", F.col("a").alias("b")), cost(spark, sf)).withColumnRenamed("cost", "own")
    return out.join(same, keys).select(*keys, F.coalesce(F.col("cost") >= 0, F.lit(False)).alias("sound"), F.coalesce(F.col("own") < 1e-9, F.lit(False)).alias("zero_when_equal"))
