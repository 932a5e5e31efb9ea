"""Catalog: summaries, contrasts and supplements of fitted relations.

The fits are outside SQL. Beside every result there is what SQL can say about it: who is
summarised and with which status, support and weights, and whether the values follow from
the fitted entries by another route.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import fitting, pairing, stats, summary
from fovea.operators.source import SOURCE_NAMES, TARGET_NAMES, RelationSource
from fovea.plans import base, transport
from fovea.plans import relations as rel
from fovea.plans.base import LEFT, RIGHT, K
from fovea.plans.catalog import query, view
from fovea.runtime import staged
from fovea.schema import FOV_KEYS

RK = ["relation_id", "patient_id"]
COORD = ["entry_type", "row_id", "col_id"]


def source(spark, sf) -> RelationSource:
    entries, ledger = transport.fitted(spark, sf)
    return RelationSource.fitted(entries, ledger, rel.support(spark, sf), rel.endpoints(spark, sf), K)


view("fitted_status", "SELECT relation_id, patient_id, CASE WHEN status = 'eligible' THEN 'ok' ELSE 'deferred' END AS fit_status, CASE WHEN status <> 'eligible' THEN status END AS defer_reason FROM support", "support")


@query("fitted_status", "H8 G17", "SELECT * FROM fitted_status", "fitted_status")
def _(spark, sf):
    return source(spark, sf).status


@query(
    "fitted_facts", "H10",
    "SELECT count(DISTINCT relation_id) AS n_relations, count(DISTINCT patient_id) AS n_patients, count(*) FILTER (fit_status <> 'ok') AS n_warnings FROM fitted_status", "fitted_status",
)
def _(spark, sf):
    return summary.fit_facts(source(spark, sf).status).select("n_relations", "n_patients", "n_warnings")


def close(a, b, tol: float = 1e-9):
    return F.coalesce(F.abs(a - b) <= tol, a.isNull() & b.isNull())


def long_family(entries, ends):
    """Family summaries from single entries, by joins: (relation, patient, summary_name, scale, value)."""
    mass = ends.select(*RK, F.posexplode(F.arrays_zip("x", "y")).alias("state_id", "m")).select(*RK, "state_id", "m.x", "m.y")
    kind = F.when(F.col("entry_type") == "e", "emergence").when(F.col("entry_type") == "d", "depletion").when(F.col("row_id") == F.col("col_id"), "self_retention").otherwise("off_diagonal_remodeling")
    state = F.when(F.col("entry_type") == "e", F.col("col_id")).otherwise(F.col("row_id"))
    each = entries.groupBy(*RK, kind.alias("summary_name"), state.alias("state_id")).agg(F.sum("value").alias("v")).join(mass, [*RK, "state_id"])
    w = F.when(F.col("summary_name") == "emergence", F.col("y")).otherwise(F.col("x"))
    both = each.groupBy(*RK, "summary_name").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("burden_weighted"), F.avg(F.when(w > 0, F.col("v"))).alias("community_mean"))
    return both.unpivot([*RK, "summary_name"], ["burden_weighted", "community_mean"], "scale", "again")


@query(
    "fitted_families", "H5",
    "SELECT relation_id, patient_id, summary_name, summary_role, scale, eligible_entity_axis, eligible_entity_count, burden_total, true AS follows FROM f_family", "f_family", "burden_total",
)
def _(spark, sf):
    """Family summaries of the fit: support and weights as SQL has them, values recomputed from the entries."""
    s = source(spark, sf)
    out = s.families().join(long_family(s.ok_entries(), s.endpoints), [*RK, "summary_name", "scale"])
    return out.withColumn("follows", close(F.col("value"), F.col("again"))).drop("value", "again")


@query("fitted_family_summaries", "H5")
def _(spark, sf):
    return source(spark, sf).families()


@query(
    "fitted_sources", "H6",
    "SELECT relation_id, patient_id, source_community_id, source_burden, source_weight, true AS adds_up FROM source_comm", "source_comm", "source_burden source_weight",
)
def _(spark, sf):
    """Source communities of the fit; what stays, goes and is remodelled makes up the state."""
    total = F.col("self_retention") + F.col("depletion") + F.col("off_diagonal_remodeling")
    sound = F.coalesce(F.abs(total - 1) <= 1e-8, F.col("source_burden") <= 0)
    return source(spark, sf).source_communities().select(*RK, "source_community_id", "source_burden", "source_weight", sound.alias("adds_up"))


@query(
    "fitted_targets", "H7",
    "SELECT relation_id, patient_id, target_community_id, target_burden, target_weight, true AS adds_up FROM target_comm", "target_comm", "target_burden target_weight",
)
def _(spark, sf):
    """Target communities of the fit; matched arrivals recomputed from the single entries."""
    s = source(spark, sf)
    mass = s.endpoints.select(*RK, F.posexplode("x").alias("row_id", "x"))
    moved = s.ok_entries().where("entry_type = 'A'").join(mass, [*RK, "row_id"]).groupBy(*RK, F.col("col_id").alias("target_community_id")).agg(F.sum(F.col("value") * F.col("x")).alias("again"))
    out = s.target_communities().join(moved, [*RK, "target_community_id"])
    sound = (F.col("target_burden") <= 0) | close(F.col("matched_incoming_burden"), F.col("again"))
    return out.select(*RK, "target_community_id", "target_burden", "target_weight", sound.alias("adds_up"))


_STATES = f"""SELECT patient_id, coalesce(max(fit_status) FILTER (relation_id = '{LEFT}'), 'missing') AS left_fit_status, coalesce(max(fit_status) FILTER (relation_id = '{RIGHT}'), 'missing') AS right_fit_status
              FROM fitted_status WHERE relation_id IN ('{LEFT}', '{RIGHT}') GROUP BY 1"""


def contrast_sql(axis: str, items: str) -> str:
    return f"""SELECT patient_id, {axis}, left_fit_status, right_fit_status,
        CASE WHEN 'deferred' IN (left_fit_status, right_fit_status) THEN 'deferred' WHEN left_fit_status = 'ok' AND right_fit_status = 'ok' THEN 'estimable' ELSE 'missing' END AS comparison_status, true AS adds_up
        FROM ({_STATES}) s CROSS JOIN ({items}) i"""


def contrast_facts(contrast, axis: list[str]):
    """Statuses of a contrast, and whether delta and direction follow from its two sides."""
    d = F.col("left_value") - F.col("right_value")
    way = F.when(d.isNull(), "not_estimable").when(F.abs(d) <= 1e-12, "left_eq_right").when(d > 0, "left_gt_right").otherwise("left_lt_right")
    sound = close(F.col("delta"), d) & (F.col("contrast_direction") == way)
    whole = F.when(F.col("comparison_status") == "estimable", sound).otherwise(F.col("delta").isNull())
    return contrast.select("patient_id", *axis, "left_fit_status", "right_fit_status", "comparison_status", whole.alias("adds_up"))


_FAMILY_ITEMS = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}')" for n, *_ in summary.SUMMARIES for s in summary.SCALES) + ") t(summary_name, scale)"


def _community_items(key: str, names: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k in range(K) for n in names) + f") t({key}, summary_name)"


@query("fitted_family_contrast", "I1 I5", contrast_sql("summary_name, scale", _FAMILY_ITEMS), "fitted_status")
def _(spark, sf):
    return contrast_facts(source(spark, sf).family_contrast(LEFT, RIGHT), ["summary_name", "scale"])


@query("fitted_source_contrast", "I2", contrast_sql("source_community_id, summary_name", _community_items("source_community_id", SOURCE_NAMES)), "fitted_status")
def _(spark, sf):
    """All states have mass at every patient of the given tables, so that status alone decides."""
    return contrast_facts(source(spark, sf).source_contrast(LEFT, RIGHT), ["source_community_id", "summary_name"])


@query("fitted_target_contrast", "I3", contrast_sql("target_community_id, summary_name", _community_items("target_community_id", TARGET_NAMES)), "fitted_status")
def _(spark, sf):
    return contrast_facts(source(spark, sf).target_contrast(LEFT, RIGHT), ["target_community_id", "summary_name"])


@query(
    "fitted_cohort", "G18 I4",
    f"SELECT relation_id, count(*) FILTER (fit_status = 'ok') AS support_n_patients, {K * (K + 2)} AS n_entries, true AS rows_sum_to_one FROM fitted_status GROUP BY 1 HAVING count(*) FILTER (fit_status = 'ok') > 0", "fitted_status",
)
def _(spark, sf):
    """Cohort template and support of the fit; the mean of row distributions is one again."""
    s = source(spark, sf)
    sums = s.template().where("entry_type <> 'e'").groupBy("relation_id", "row_id").agg(F.sum("value").alias("v"))
    whole = sums.groupBy("relation_id").agg(F.bool_and(F.abs(F.col("v") - 1) < 1e-8).alias("rows_sum_to_one"))
    size = s.template().groupBy("relation_id").agg(F.count(F.lit(1)).cast("int").alias("n_entries"))
    return s.cohort().select("relation_id", "support_n_patients").join(size, "relation_id").join(whole, "relation_id")


@query("fitted_cohort_contrast", "I4")
def _(spark, sf):
    return source(spark, sf).cohort_contrast(LEFT, RIGHT)


@query("fitted_family_supplement", "I12 I13 I17 I18")
def _(spark, sf):
    return stats.paired_supplement(source(spark, sf).family_contrast(LEFT, RIGHT), ["summary_name", "scale"])


@query("fitted_element_supplement", "I19")
def _(spark, sf):
    return source(spark, sf).element_supplement(LEFT, RIGHT)


_PAIRED = f"(SELECT count(*) FROM fitted_status a JOIN fitted_status b USING (patient_id) WHERE a.relation_id = '{LEFT}' AND b.relation_id = '{RIGHT}' AND a.fit_status = 'ok' AND b.fit_status = 'ok')"


@query(
    "fitted_supplement_checks", "I18 I19",
    f"SELECT 'family' AS level, count(*) AS n_tests, {_PAIRED} AS n_patients, true AS sound FROM ({_FAMILY_ITEMS}) UNION ALL SELECT 'element', {K * (K + 2)}, {_PAIRED}, true", "fitted_status",
)
def _(spark, sf):
    """Every test is over all patients fitted on both sides; q values are not below their p values, signs add up."""
    s = source(spark, sf)
    signs = F.col("support_positive_n") + F.col("support_negative_n") + F.col("support_zero_n") == F.col("n_patients")
    sound = signs & F.coalesce((F.col("bh_q_value") >= F.col("wilcoxon_p_value") - 1e-12) & F.col("bh_q_value").between(0, 1), F.col("wilcoxon_p_value").isNull())

    def facts(level, table):
        return table.agg(F.count(F.lit(1)).alias("n_tests"), F.max("n_patients").alias("n_patients"), F.bool_and(sound & F.lit(True)).alias("sound")).select(F.lit(level).alias("level"), "n_tests", "n_patients", "sound")

    return facts("family", stats.paired_supplement(s.family_contrast(LEFT, RIGHT), ["summary_name", "scale"])).unionByName(facts("element", s.element_supplement(LEFT, RIGHT)))


# --- calibration of fitted relations -------------------------------------------

#: Permutations that are fitted; each is a cohort of its own, fitted by the schedule of the observed one.
N_FITTED = 19


def permuted_pairs(spark, sf):
    """FOV pairs of the observed family (relation -1) and of every permutation, in one table."""
    seen = rel.family_fovs(spark, sf).select(F.lit(-1).alias("permutation_index"), *FOV_KEYS, "domain_label")
    null = rel.permutations(spark, sf, N_FITTED).select("permutation_index", *FOV_KEYS, F.col("permuted_domain_label").alias("domain_label"))
    side = F.when(F.col("domain_label") == rel.SRC, "source").otherwise("target")
    chosen = seen.unionByName(null).select(F.col("permutation_index").cast("string").alias("relation_id"), "patient_id", side.alias("side"), "timepoint", "domain_label", "fov_id")
    blocks = pairing.evidence_blocks(pairing.ordered_bags(chosen), pairing.relation_support(chosen))
    return pairing.block_pairs(blocks, base.fov_vectors(spark, sf))


def permuted_fit(spark, sf):
    """Entries (permutation_index, patient_id, ...) of one fit over all cohorts at once."""
    build = lambda: fitting.fit_relations(staged(spark, "permuted_pairs", sf, lambda: permuted_pairs(spark, sf)), transport.cost(spark, sf), K).entries
    return staged(spark, "permuted_fit", sf, build).withColumn("permutation_index", F.col("relation_id").cast("int")).drop("relation_id")


def permuted_families(spark, sf):
    """(observed, null) family summaries of the fits."""
    keys = ["permutation_index", "patient_id"]
    ends = rel.real_endpoints(spark, sf).unionByName(rel.null_endpoints(spark, sf, N_FITTED))
    out = summary.family_summaries(summary.packed_with_burden(permuted_fit(spark, sf), ends, keys, K), keys)
    return out.where("permutation_index < 0"), out.where("permutation_index >= 0")


@query("fitted_patient_calibration", "F10 G17 I20 I21 I22 I23")
def _(spark, sf):
    return stats.patient_calibration(*permuted_families(spark, sf))


@query("fitted_cohort_calibration", "F10 G17 I24")
def _(spark, sf):
    return stats.cohort_calibration(*permuted_families(spark, sf))


@query(
    "fitted_calibration_checks", "F10 G17 I20 I23",
    f"""SELECT patient_id, summary_name, scale, reference_stat, CASE WHEN summary_name = 'self_retention' THEN 'left' ELSE 'right' END AS expected_tail, {N_FITTED} AS n_reference, true AS follows
        FROM freal_family CROSS JOIN (VALUES ('median'), ('mean')) s(reference_stat)""",
    "freal_family",
)
def _(spark, sf):
    """Every patient of the family is set against all permutations; tail and reference recounted from the sorted null values."""
    real, null = permuted_families(spark, sf)
    axis = ["patient_id", "summary_name", "scale"]
    sorted_ = null.groupBy(*axis).agg(F.array_sort(F.collect_list(F.round("value", 12))).alias("nulls"))
    seen = sorted_.join(real.select(*axis, F.round("value", 12).alias("seen")), axis)
    out = stats.patient_calibration(real, null).join(seen, axis)
    left = F.size(F.filter("nulls", lambda v: v <= F.col("seen")))
    right = F.size(F.filter("nulls", lambda v: v >= F.col("seen")))
    k = F.when(F.col("expected_tail") == "left", left).otherwise(right)
    middle = F.when(F.col("reference_stat") == "median", F.get("nulls", F.lit(N_FITTED // 2))).otherwise(F.aggregate("nulls", F.lit(0.0), lambda a, v: a + v) / N_FITTED)
    sound = close(F.col("empirical_p_value"), (1 + k) / (1 + N_FITTED)) & close(F.col("null_reference"), middle) & close(F.col("effect_delta"), F.col("real_value") - middle)
    return out.select(*axis, "reference_stat", "expected_tail", F.size("nulls").alias("n_reference"), sound.alias("follows"))
