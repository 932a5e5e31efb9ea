"""Catalog: report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import compose, recovery, reports, stats
from fovea.plans import base
from fovea.plans import relations as rel
from fovea.plans import statistics as st
from fovea.plans.base import DOMAINS, K, SUBTYPES
from fovea.plans.catalog import query, view
from fovea.runtime import literal_table, staged

CHOSEN = ["ECONOMY", "LARGE", "PROMO"]
_IN = ", ".join(f"'{t}'" for t in CHOSEN)


def mix(spark, sf):
    return staged(spark, "mix", sf, lambda: compose.category_mix(base.cells(spark, sf), "cell_subtype_label", SUBTYPES, K))


def distribution(spark, sf):
    return staged(spark, "distribution", sf, lambda: compose.domain_distribution(base.cells(spark, sf), DOMAINS, K))


@query(
    "state_row_order", "L1",
    f"""SELECT state_id, selected_fraction, patient_prevalence, fov_prevalence, n_patients_present, CAST(row_number() OVER (ORDER BY round(selected_fraction, 12) DESC, round(patient_prevalence, 12) DESC, state_id) AS INT) AS row_position FROM
        (SELECT state_id, sum(fraction) AS selected_fraction FROM type_mix WHERE cell_subtype_label IN ({_IN}) GROUP BY 1) LEFT JOIN occurrence USING (state_id)""",
    "type_mix occurrence", "selected_fraction patient_prevalence fov_prevalence",
)
def _(spark, sf):
    return reports.state_row_order(mix(spark, sf), compose.patient_occurrence(base.cells(spark, sf), K), CHOSEN)


@query(
    "state_domain_matrix", "L2",
    "SELECT state_id, " + ", ".join(f"max(CASE WHEN domain_label = '{d}' THEN fraction_within_community END) AS \"{d}\"" for d in DOMAINS) + " FROM domain_dist GROUP BY 1",
    "domain_dist", " ".join(DOMAINS),
)
def _(spark, sf):
    return reports.state_domain_matrix(distribution(spark, sf), DOMAINS)


@query(
    "selected_states", "L3",
    f"SELECT state_id FROM type_mix WHERE cell_subtype_label IN ({_IN}) GROUP BY 1 HAVING sum(fraction) > 0.5 UNION SELECT state_id FROM domain_dist WHERE domain_label = 'BUILDING' AND fraction_within_community > 0.2", "type_mix domain_dist",
)
def _(spark, sf):
    return reports.selected_states(reports.type_dominant_states(mix(spark, sf), CHOSEN), reports.domain_rich_states(distribution(spark, sf), "BUILDING", 0.2))


@query("stacked_families", "L4")
def _(spark, sf):
    cal = stats.cohort_calibration(st.real_summaries(spark, sf), st.null_summaries(spark, sf))
    sup = stats.paired_supplement(st.family_contrast(spark, sf), ["summary_name", "scale"])
    return reports.stacked_families(cal, sup, ["self_retention", "depletion", "off_diagonal_remodeling"])


@query(
    "stacked_family_values", "L4",
    """SELECT summary_name, 'null' AS "group", median(m) AS value FROM (SELECT summary_name, permutation_index, median(value) AS m FROM fnull_family WHERE scale = 'burden_weighted' GROUP BY 1, 2) GROUP BY 1
       UNION ALL SELECT summary_name, 'left', median(value) FROM freal_family WHERE scale = 'burden_weighted' GROUP BY 1
       UNION ALL SELECT summary_name, 'right', right_median FROM family_payload WHERE scale = 'burden_weighted'""",
    "fnull_family freal_family family_payload", "value",
)
def _(spark, sf):
    names = ["self_retention", "depletion", "off_diagonal_remodeling", "emergence"]
    cal = stats.cohort_calibration(st.real_summaries(spark, sf), st.null_summaries(spark, sf))
    sup = stats.paired_payload(st.family_contrast(spark, sf).where("comparison_status = 'estimable'"), ["summary_name", "scale"])
    none = F.lit(None).cast("double")
    return reports.stacked_families(cal, sup.withColumn("wilcoxon_p_value", none).withColumn("bh_q_value", none), names).select("summary_name", "group", "value")


view(
    "examples",
    """SELECT patient_id, source_community_id, summary_name, 'left' AS pair_family, left_value AS value FROM source_contrast WHERE comparison_status = 'estimable' AND left_value IS NOT NULL AND right_value IS NOT NULL
       UNION ALL SELECT patient_id, source_community_id, summary_name, 'right', right_value FROM source_contrast WHERE comparison_status = 'estimable' AND left_value IS NOT NULL AND right_value IS NOT NULL""",
    "source_contrast",
)


@query("pair_examples", "L5", "SELECT * FROM examples", "examples", "value")
def _(spark, sf):
    return reports.pair_examples(st.source_contrast(spark, sf))


@query("pair_segments", "L5", "SELECT patient_id, source_community_id, summary_name, left_value AS value_left, right_value AS value_right FROM source_contrast WHERE comparison_status = 'estimable' AND left_value IS NOT NULL AND right_value IS NOT NULL", "source_contrast", "value_left value_right")
def _(spark, sf):
    return reports.pair_segments(reports.pair_examples(st.source_contrast(spark, sf)))


@query("example_medians", "L5", "SELECT source_community_id, summary_name, pair_family, median(value) AS value FROM examples GROUP BY 1, 2, 3", "examples", "value")
def _(spark, sf):
    return reports.example_medians(reports.pair_examples(st.source_contrast(spark, sf)))


# Display factors of the report; other metrics keep factor one.
SCALING = [("d_mae", 100.0), ("e_mae", 100.0), ("a_mse_active", 1000.0)]
view("scaling", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {v})" for m, v in SCALING) + ") t(metric_name, display_multiplier)")
view("e_metrics", "SELECT rerun_id, method_name, metric_name, avg(value) AS value_raw, any_value(coalesce(display_multiplier, 1)) + 0.0 AS display_multiplier, avg(value) * any_value(coalesce(display_multiplier, 1)) AS value_display FROM rerun_rows LEFT JOIN scaling USING (metric_name) GROUP BY 1, 2, 3", "rerun_rows", "scaling")
view(
    "e_ranges",
    "SELECT metric_name, x_min, x_max, greatest(x_max - x_min, abs(x_max) * 0.25, 0.01) AS x_range, x_min + greatest(x_max - x_min, abs(x_max) * 0.25, 0.01) * 0.5 AS x_na FROM (SELECT metric_name, min(value_display) AS x_min, max(value_display) AS x_max FROM e_metrics GROUP BY 1)",
    "e_metrics",
)


def e_metrics(spark, sf):
    scaling = literal_table(spark, ["metric_name", "display_multiplier"], SCALING)
    return staged(spark, "e_metrics", sf, lambda: reports.rerun_metrics(st.rerun_rows(spark, sf), scaling, []))


@query("rerun_metrics", "L6", "SELECT * FROM e_metrics", "e_metrics", "value_raw display_multiplier value_display")
def _(spark, sf):
    return e_metrics(spark, sf)


@query("metric_ranges", "L7", "SELECT * FROM e_ranges", "e_ranges", "x_min x_max x_range x_na")
def _(spark, sf):
    return reports.metric_ranges(e_metrics(spark, sf))


_METHODS = ["diagonal", "cohort_mean", "blend", "partial"]
_GRID = ["f_l1_total", "offdiag_ratio", "d_mae", "e_mae"]


@query(
    "missing_slots", "L8",
    f"""SELECT g.metric_name, g.method_name, x_min, x_max, x_range, x_na FROM (SELECT * FROM (VALUES {base.sql_list(_GRID)}) a(metric_name), (VALUES {base.sql_list(_METHODS)}) b(method_name)) g LEFT JOIN e_ranges USING (metric_name)
        WHERE (g.metric_name, g.method_name) NOT IN (SELECT (metric_name, method_name) FROM e_metrics WHERE value_raw IS NOT NULL)""",
    "e_ranges e_metrics", "x_min x_max x_range x_na",
)
def _(spark, sf):
    return reports.missing_slots(e_metrics(spark, sf), _GRID, _METHODS)


def rank_view(name: str, pairs: str, unit: str) -> None:
    view(
        name,
        f"""SELECT {unit}, n_pairs, CASE WHEN n_pairs > 1 THEN n_nonzero END AS n_nonzero, CASE WHEN n_pairs > 1 THEN w_plus END AS w_plus, CASE WHEN n_pairs > 1 THEN tie_term END AS tie_term FROM
            (SELECT {unit}, count(delta) AS n_pairs FROM {pairs} WHERE delta IS NOT NULL GROUP BY ALL) LEFT JOIN
            (SELECT {unit}, count(*) AS n_nonzero, coalesce(sum(r) FILTER (delta > 0), 0) AS w_plus, CAST(sum(t * t - 1) AS DOUBLE) AS tie_term FROM
             (SELECT *, rank() OVER (PARTITION BY {unit} ORDER BY round(abs(delta), 12)) + (count(*) OVER (PARTITION BY {unit}, round(abs(delta), 12)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {unit}, round(abs(delta), 12)) AS t FROM {pairs} WHERE abs(delta) > 1e-12) GROUP BY ALL) USING ({unit})""",
        pairs,
    )


view("e_pairs", f"SELECT a.rerun_id, a.metric_name, a.method_name, a.value_raw - b.value_raw AS delta FROM e_metrics a JOIN e_metrics b USING (rerun_id, metric_name) WHERE a.method_name <> '{st.REF}' AND b.method_name = '{st.REF}'", "e_metrics")
rank_view("e_tests", "e_pairs", "metric_name, method_name")


@query("method_pair_tests", "L9")
def _(spark, sf):
    pairs = reports.method_pairs(e_metrics(spark, sf), st.REF)
    return reports.with_normal_p(reports.normal_rank_tests(pairs, ["metric_name", "method_name"]), "significance_label")


@query("method_pair_counts", "L9", "SELECT metric_name, method_name, n_pairs FROM e_tests", "e_tests")
def _(spark, sf):
    return reports.normal_rank_tests(reports.method_pairs(e_metrics(spark, sf), st.REF), ["metric_name", "method_name"]).select("metric_name", "method_name", "n_pairs")


view("fam_metrics", "SELECT condition_id AS evaluation_family, rerun_id, method_name, metric_name, avg(value) AS value_raw FROM rerun_rows GROUP BY 1, 2, 3, 4", "rerun_rows")


@query(
    "shared_reference", "L10",
    f"""SELECT rerun_id, method_name, metric_name, avg(value_raw) AS value_raw, 'shared_reference' AS evaluation_family FROM fam_metrics WHERE method_name = '{st.REF}' GROUP BY 1, 2, 3
        UNION ALL SELECT rerun_id, method_name, metric_name, value_raw, evaluation_family FROM fam_metrics WHERE method_name <> '{st.REF}'""",
    "fam_metrics", "value_raw",
)
def _(spark, sf):
    none = literal_table(spark, ["metric_name", "display_multiplier"], SCALING)
    metrics = reports.rerun_metrics(st.rerun_rows(spark, sf), none, ["condition_id"]).withColumnRenamed("condition_id", "evaluation_family")
    return reports.shared_reference(metrics, st.REF)


_SEL = [0, 2, 3]
view(
    "pdf",
    """SELECT patient_id, domain_label, n AS domain_total_cells, s.state_id, coalesce(c, 0) AS community_cells, coalesce(c, 0) / n AS community_fraction FROM (SELECT patient_id, domain_label, count(*) AS n FROM cells GROUP BY 1, 2)
       CROSS JOIN (SELECT state_id FROM states WHERE state_id IN (0, 2, 3)) s LEFT JOIN (SELECT patient_id, domain_label, state_id, count(*) AS c FROM cells GROUP BY 1, 2, 3) USING (patient_id, domain_label, state_id)""",
    "cells", "states",
)


def fractions(spark, sf):
    return staged(spark, "pdf", sf, lambda: reports.patient_domain_fractions(base.cells(spark, sf), _SEL))


@query("patient_domain_fractions", "L11", "SELECT * FROM pdf", "pdf", "community_fraction")
def _(spark, sf):
    return fractions(spark, sf)


_CON = [("BUILDING", "MACHINERY"), ("BUILDING", "FURNITURE"), ("MACHINERY", "FURNITURE")]
view(
    "dom_pairs",
    " UNION ALL ".join(
        f"SELECT patient_id, state_id, '{a}-{b}' AS contrast, max(community_fraction) FILTER (domain_label = '{a}') - max(community_fraction) FILTER (domain_label = '{b}') AS delta FROM pdf GROUP BY 1, 2" for a, b in _CON
    ),
    "pdf",
)
rank_view("dom_tests", "dom_pairs", "state_id, contrast")


@query("domain_rank_sums", "L12", "SELECT * FROM dom_tests", "dom_tests", "w_plus tie_term")
def _(spark, sf):
    return reports.normal_rank_tests(reports.domain_contrasts(fractions(spark, sf), _CON), ["state_id", "contrast"])


@query("domain_pair_tests", "L12")
def _(spark, sf):
    tests = reports.normal_rank_tests(reports.domain_contrasts(fractions(spark, sf), _CON), ["state_id", "contrast"])
    return reports.with_normal_p(tests, "stat_label")


@query("json_profiles", "L13", "SELECT rerun_index AS rerun_id, patient_id, state_id AS feature_index, any_value(x) AS x, any_value(y) AS y FROM profiles WHERE relation_id = '" + base.LEFT + "' GROUP BY 1, 2, 3", "profiles", "x y")
def _(spark, sf):
    p = st.profiles(spark, sf).where(F.col("relation_id") == base.LEFT)
    rows = p.select(F.col("rerun_index").alias("rerun_id"), "patient_id", F.to_json("x").alias("x_json"), F.to_json("y").alias("y_json"))
    return reports.json_profiles(rows.unionByName(rows), "x_json", "y_json")


view("long_profiles", "SELECT rerun_index AS rerun_id, relation_id, patient_id, state_id, x, y AS observed, syn AS generated FROM profiles", "profiles")


def long_profiles(spark, sf):
    p = st.profiles(spark, sf)
    zipped = F.arrays_zip("x", "y", "syn")
    return p.select(F.col("rerun_index").alias("rerun_id"), "relation_id", "patient_id", F.posexplode(zipped).alias("state_id", "p")).select(
        "rerun_id", "relation_id", "patient_id", "state_id", "p.x", F.col("p.y").alias("observed"), F.col("p.syn").alias("generated")
    )


@query(
    "profile_differences", "L14",
    """SELECT *, max(abs(mean_difference)) OVER () AS difference_limit FROM (SELECT 'observed' AS difference_source, rerun_id, state_id, avg(observed - x) AS mean_difference FROM long_profiles GROUP BY 2, 3
       UNION ALL SELECT 'generated', rerun_id, state_id, avg(generated - x) FROM long_profiles GROUP BY 2, 3)""",
    "long_profiles", "mean_difference difference_limit",
)
def _(spark, sf):
    return reports.profile_differences(long_profiles(spark, sf))


_PM = [("x_obs", "x", "y"), ("syn_obs", "syn", "y"), ("x_syn", "x", "syn")]
for _name, _a, _b in _PM:
    view(f"pm_{_name}", st.metric_sql("profiles", "rerun_index, relation_id, patient_id", _a, _b), "profiles")
view(
    "patient_pm",
    "SELECT rerun_index AS rerun_id, relation_id, patient_id, " + ", ".join(f"pm_{n}.{m} AS {n}_{m}" for n, *_ in _PM for m in ("pearson", "mae", "js_divergence"))
    + " FROM pm_x_obs JOIN pm_syn_obs USING (rerun_index, relation_id, patient_id) JOIN pm_x_syn USING (rerun_index, relation_id, patient_id)",
    "pm_x_obs", "pm_syn_obs", "pm_x_syn",
)
_PMC = [f"{n}_{m}" for n, *_ in _PM for m in ("pearson", "mae", "js_divergence")]
view("rerun_pm", "SELECT rerun_id, " + ", ".join(f"avg({c}) AS {c}" for c in _PMC) + " FROM patient_pm GROUP BY 1", "patient_pm")


def patient_profile_metrics(spark, sf):
    df = st.profiles(spark, sf)
    for name, a, b in _PM:
        df = recovery.profile_metrics(df, a, b, f"{name}_")
    return df.select(F.col("rerun_index").alias("rerun_id"), "relation_id", "patient_id", *_PMC)


def rerun_profile_metrics(spark, sf):
    return patient_profile_metrics(spark, sf).groupBy("rerun_id").agg(*[F.avg(c).alias(c) for c in _PMC])


@query("patient_profile_metrics", "L15", "SELECT * FROM patient_pm", "patient_pm", " ".join(_PMC))
def _(spark, sf):
    return patient_profile_metrics(spark, sf)


@query("rerun_profile_metrics", "L15", "SELECT * FROM rerun_pm", "rerun_pm", " ".join(_PMC))
def _(spark, sf):
    return rerun_profile_metrics(spark, sf)


_PAIRS = [
    ("left", "pearson", "syn_obs_pearson", "x_obs_pearson"), ("left", "mae", "syn_obs_mae", "x_obs_mae"), ("left", "js", "syn_obs_js_divergence", "x_obs_js_divergence"),
    ("right", "mae", "x_syn_mae", "x_obs_mae"), ("right", "js", "x_syn_js_divergence", "x_obs_js_divergence"),
]
view("pm_pairs", " UNION ALL ".join(f"SELECT rerun_id, '{k}' AS plot_block, '{m}' AS metric_label, {a} - {b} AS delta FROM rerun_pm" for k, m, a, b in _PAIRS), "rerun_pm")
rank_view("pm_tests", "pm_pairs", "plot_block, metric_label")


def profile_tests(spark, sf):
    return reports.normal_rank_tests(reports.metric_contrasts(rerun_profile_metrics(spark, sf), _PAIRS), ["plot_block", "metric_label"])


@query("profile_rank_sums", "L16", "SELECT * FROM pm_tests", "pm_tests", "w_plus tie_term")
def _(spark, sf):
    return profile_tests(spark, sf)


@query("profile_pair_tests", "L16")
def _(spark, sf):
    return reports.with_normal_p(profile_tests(spark, sf), "stat_label")
