"""Catalog: group comparisons, paired contrasts, calibration and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.functions import pvalues
from fovea.operators import compose, estimate, quality, recovery, resampling, stats, summary
from fovea.plans import base
from fovea.plans import relations as rel
from fovea.plans.base import K, LEFT, RIGHT
from fovea.plans.catalog import query, view
from fovea.runtime import literal_table, staged
from fovea.schema import COORD
from fovea.sources.sinks import fraction_report

RK = ["relation_id", "patient_id"]
_UNIT = "relation_id, entry_type, row_id, col_id"
COMPARISONS = [
    ("africa_vs_asia", ["AFRICA", "ASIA"]),
    ("europe_vs_america", ["EUROPE", "AMERICA"]),
    ("all_regions", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]),
]


def comparisons(spark):
    return literal_table(spark, ["comparison_id", "groups"], COMPARISONS)


view(
    "comparisons",
    "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {len(g)}, {i}, '{n}')" for c, g in COMPARISONS for i, n in enumerate(g)) + ") t(comparison_id, n_groups, place, group_id)",
)
view("test_rows", f"SELECT {_UNIT}, patient_id, value, comparison_id, n_groups, place, group_id FROM gated JOIN grps USING (patient_id) JOIN comparisons USING (group_id)", "gated", "grps", "comparisons")


def test_rows(spark, sf):
    return stats.entry_rows(rel.gated(spark, sf), base.groups(spark, sf), comparisons(spark))


@query(
    "group_description", "I6",
    f"SELECT {_UNIT}, comparison_id, group_id, place, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std FROM test_rows GROUP BY ALL",
    "test_rows", "mean median std",
)
def _(spark, sf):
    return stats.group_description(test_rows(spark, sf), stats.ENTRY_UNIT)


view(
    "ranked",
    f"SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {_UNIT}, comparison_id, value) - 1) / 2.0 AS avg_rank, count(*) OVER (PARTITION BY {_UNIT}, comparison_id, value) AS ties FROM (SELECT * REPLACE (round(value, 12) AS value) FROM test_rows WHERE n_groups = 2) WINDOW w AS (PARTITION BY {_UNIT}, comparison_id ORDER BY value)",
    "test_rows",
)
view(
    "u_stats",
    f"""SELECT {_UNIT}, comparison_id, n1, n2, tie_term, r1 - n1 * (n1 + 1) / 2.0 AS u1, 2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1 AS effect_size FROM
        (SELECT {_UNIT}, comparison_id, count(*) FILTER (place = 0) AS n1, count(*) FILTER (place = 1) AS n2, sum(avg_rank) FILTER (place = 0) AS r1, CAST(sum(ties * ties - 1) AS DOUBLE) AS tie_term FROM ranked GROUP BY ALL)""",
    "ranked",
)


@query("rank_sum_statistics", "I7 I8", "SELECT * FROM u_stats", "u_stats", "u1 effect_size tie_term")
def _(spark, sf):
    return stats.rank_sums(test_rows(spark, sf), stats.ENTRY_UNIT)


@query(
    "exact_rank_tests", "I7",
    f"""WITH dist AS (SELECT u, count(*) AS c FROM (SELECT m, sum(b + 1) - 15 AS u FROM range(1024) t(m), range(10) r(b) WHERE ((m >> b) & 1) = 1 GROUP BY m HAVING count(*) = 5) GROUP BY 1)
        SELECT {_UNIT}, comparison_id, least(1.0, 2 * (SELECT sum(c) FROM dist WHERE u >= greatest(u1, 25 - u1)) / 252.0) AS p_value FROM u_stats WHERE tie_term = 0 AND n1 = 5 AND n2 = 5""",
    "u_stats", "p_value",
)
def _(spark, sf):
    sums = stats.rank_sums(test_rows(spark, sf), stats.ENTRY_UNIT).where("tie_term = 0 AND n1 = 5 AND n2 = 5")
    return sums.select(*stats.ENTRY_UNIT, "comparison_id", pvalues.mann_whitney_p("u1", "n1", "n2", "tie_term").alias("p_value"))


@query(
    "cliffs_delta_pairs", "I8",
    f"""SELECT {_UNIT}, comparison_id, (count(*) FILTER (a.value > b.value) - count(*) FILTER (a.value < b.value)) / count(*) AS effect_size
        FROM (SELECT * REPLACE (round(value, 12) AS value) FROM test_rows WHERE n_groups = 2 AND place = 0) a JOIN (SELECT * REPLACE (round(value, 12) AS value) FROM test_rows WHERE n_groups = 2 AND place = 1) b USING ({_UNIT}, comparison_id) GROUP BY ALL""",
    "test_rows", "effect_size",
)
def _(spark, sf):
    # the reference SQL counts pairs; the engine derives the same from ranks
    return stats.rank_sums(test_rows(spark, sf), stats.ENTRY_UNIT).select(*stats.ENTRY_UNIT, "comparison_id", "effect_size")


view(
    "anova",
    f"""SELECT {_UNIT}, comparison_id, hi - lo <= 1e-8 + 1e-5 * abs(lo) AS flat, k - 1.0 AS df1, nn - k + 0.0 AS df2, ssb, ssw FROM
        (SELECT {_UNIT}, comparison_id, count(*) AS k, sum(n) AS nn, sum(n * (m - gm) * (m - gm)) AS ssb, sum(n * v) AS ssw, min(lo) AS lo, max(hi) AS hi FROM
         (SELECT *, sum(n * m) OVER (PARTITION BY {_UNIT}, comparison_id) / sum(n) OVER (PARTITION BY {_UNIT}, comparison_id) AS gm FROM
          (SELECT {_UNIT}, comparison_id, group_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v, min(value) AS lo, max(value) AS hi FROM test_rows WHERE n_groups > 2 GROUP BY ALL)) GROUP BY ALL)""",
    "test_rows",
)


@query(
    "variance_tests", "I9 I10",
    f"""SELECT {_UNIT}, comparison_id, CASE WHEN flat OR ssb + ssw <= 0 THEN 0 ELSE ssb / (ssb + ssw) END AS effect_size,
        CASE WHEN flat THEN 1.0 ELSE x ** (df2 / 2) * (1 + df2 / 2 * (1 - x)) END AS p_value FROM (SELECT *, df2 / (df2 + 4.0 * ((ssb / 4.0) / nullif(ssw / df2, 0))) AS x FROM anova)""",
    "anova", "effect_size p_value",
)
def _(spark, sf):
    parts = stats.variance_parts(test_rows(spark, sf), stats.ENTRY_UNIT)
    p = F.when(F.col("flat"), 1.0).otherwise(pvalues.f_tail_p("f_value", "df1", "df2"))
    return parts.select(*stats.ENTRY_UNIT, "comparison_id", "effect_size", p.alias("p_value"))


view(
    "anova_p",
    f"""SELECT {_UNIT}, comparison_id, CASE WHEN flat THEN 1.0 ELSE x ** (df2 / 2) * (1 + df2 / 2 * (1 - x)) END AS p_value FROM (SELECT *, df2 / (df2 + 4.0 * ((ssb / 4.0) / nullif(ssw / df2, 0))) AS x FROM anova)""",
    "anova",
)


@query(
    "corrected_q_values", "I11",
    f"""SELECT *, least(1.0, min(p_value * n / r) OVER (PARTITION BY relation_id, comparison_id ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM
        (SELECT *, count(*) OVER (PARTITION BY relation_id, comparison_id) AS n, row_number() OVER (PARTITION BY relation_id, comparison_id ORDER BY p_value) AS r FROM anova_p)""".replace("SELECT *, least", f"SELECT {_UNIT}, comparison_id, p_value, least"),
    "anova_p", "p_value q_value",
)
def _(spark, sf):
    parts = stats.variance_parts(test_rows(spark, sf), stats.ENTRY_UNIT)
    p = F.when(F.col("flat"), 1.0).otherwise(pvalues.f_tail_p("f_value", "df1", "df2"))
    return stats.with_bh(parts.select(*stats.ENTRY_UNIT, "comparison_id", p.alias("p_value")), ["relation_id", "comparison_id"])


def _flat(df):
    """Maps as text so that the rows compare as plain values."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])


@query("entry_group_association", "I15")
def _(spark, sf):
    return _flat(stats.group_association(test_rows(spark, sf), stats.ENTRY_UNIT))


@query("q_size_levels", "I42", f"SELECT {_UNIT}, comparison_id, CASE WHEN p_value <= 0.001 THEN '***' WHEN p_value <= 0.01 THEN '**' WHEN p_value <= 0.05 THEN '*' ELSE 'ns' END AS stars, CASE WHEN p_value <= 0 THEN 4 ELSE CAST(least(4, greatest(0, floor(-log10(p_value)))) AS INT) END AS size_level FROM anova_p", "anova_p")
def _(spark, sf):
    parts = stats.variance_parts(test_rows(spark, sf), stats.ENTRY_UNIT)
    p = F.when(F.col("flat"), 1.0).otherwise(pvalues.f_tail_p("f_value", "df1", "df2"))
    tests = parts.select(*stats.ENTRY_UNIT, "comparison_id", p.alias("p_value"))
    return tests.select(*stats.ENTRY_UNIT, "comparison_id", stats.stars(F.col("p_value")).alias("stars"), stats.size_level(F.col("p_value")).alias("size_level"))


# --- paired contrasts --------------------------------------------------------

_DIR = "CASE WHEN {d} IS NULL THEN 'not_estimable' WHEN abs({d}) <= 1e-12 THEN 'left_eq_right' WHEN {d} > 0 THEN 'left_gt_right' ELSE 'left_lt_right' END"
_NAMES = [n for n, *_ in summary.SUMMARIES]


def contrast_view(name: str, values: str, axis: str, items: str) -> None:
    view(
        name,
        f"""SELECT *, {_DIR.format(d='delta')} AS contrast_direction FROM (SELECT patient_id, {axis}, comparison_status,
              CASE WHEN comparison_status <> 'deferred' AND hl THEN lv END AS left_value, CASE WHEN comparison_status <> 'deferred' AND hr THEN rv END AS right_value,
              left_fit_status, right_fit_status, CASE WHEN comparison_status = 'estimable' THEN lv - rv END AS delta FROM
            (SELECT *, left_fit_status = 'ok' AND ln AS hl, right_fit_status = 'ok' AND rn AS hr,
               CASE WHEN left_fit_status = 'deferred' OR right_fit_status = 'deferred' THEN 'deferred' WHEN left_fit_status = 'ok' AND ln AND right_fit_status = 'ok' AND rn THEN 'estimable' ELSE 'missing' END AS comparison_status FROM
             (SELECT s.patient_id, {', '.join('i.' + a for a in axis.split(', '))}, s.left_fit_status, s.right_fit_status, l.value AS lv, r.value AS rv, l.patient_id IS NOT NULL AS ln, r.patient_id IS NOT NULL AS rn FROM
               (SELECT patient_id, coalesce(max(fit_status) FILTER (relation_id = '{LEFT}'), 'missing') AS left_fit_status, coalesce(max(fit_status) FILTER (relation_id = '{RIGHT}'), 'missing') AS right_fit_status
                FROM fits WHERE relation_id IN ('{LEFT}', '{RIGHT}') GROUP BY 1) s CROSS JOIN ({items}) i
               LEFT JOIN (SELECT * FROM {values} WHERE relation_id = '{LEFT}') l ON l.patient_id = s.patient_id AND {' AND '.join(f'l.{a} = i.{a}' for a in axis.split(', '))}
               LEFT JOIN (SELECT * FROM {values} WHERE relation_id = '{RIGHT}') r ON r.patient_id = s.patient_id AND {' AND '.join(f'r.{a} = i.{a}' for a in axis.split(', '))})))""",
        values, "fits",
    )


contrast_view("family_contrast", "f_family", "summary_name, scale", "SELECT DISTINCT summary_name, scale FROM f_family")
_SRC_NAMES = ["self_retention", "depletion", "off_diagonal_remodeling"]
_TGT_NAMES = ["matched_incoming_burden", "open_incoming_tendency", "open_incoming_burden"]
for _table, _id, _names in (("source", "source_community_id", _SRC_NAMES), ("target", "target_community_id", _TGT_NAMES)):
    view(f"{_table}_long", " UNION ALL ".join(f"SELECT relation_id, patient_id, {_id}, '{n}' AS summary_name, {n} AS value FROM {_table}_comm" for n in _names), f"{_table}_comm")
    contrast_view(f"{_table}_contrast", f"{_table}_long", f"{_id}, summary_name", f"SELECT DISTINCT {_id}, summary_name FROM {_table}_long")
_CD = "left_value right_value delta"


def family_contrast(spark, sf):
    rows = [(n, s) for n in _NAMES for s in summary.SCALES]
    return stats.paired_contrast(rel.family(spark, sf), rel.fits(spark, sf), ["summary_name", "scale"], rows, LEFT, RIGHT)


def source_contrast(spark, sf):
    long = stats.unpivot_communities(summary.source_communities(rel.packed(spark, sf), RK), "source_community_id", _SRC_NAMES)
    rows = [(k, n) for k in range(K) for n in _SRC_NAMES]
    return stats.paired_contrast(long, rel.fits(spark, sf), ["source_community_id", "summary_name"], rows, LEFT, RIGHT)


def target_contrast(spark, sf):
    long = stats.unpivot_communities(summary.target_communities(rel.packed(spark, sf), RK), "target_community_id", _TGT_NAMES)
    rows = [(k, n) for k in range(K) for n in _TGT_NAMES]
    return stats.paired_contrast(long, rel.fits(spark, sf), ["target_community_id", "summary_name"], rows, LEFT, RIGHT)


@query("family_contrast", "I1 I5", "SELECT * FROM family_contrast", "family_contrast", _CD)
def _(spark, sf):
    return family_contrast(spark, sf)


@query("source_community_contrast", "I2", "SELECT * FROM source_contrast", "source_contrast", _CD)
def _(spark, sf):
    return source_contrast(spark, sf)


@query("target_community_contrast", "I3", "SELECT * FROM target_contrast", "target_contrast", _CD)
def _(spark, sf):
    return target_contrast(spark, sf)


@query(
    "cohort_contrast", "I4",
    f"""SELECT a.entry_type, a.row_id, a.col_id, a.value AS left_value, b.value AS right_value, a.value - b.value AS delta, {_DIR.format(d='(a.value - b.value)')} AS contrast_direction,
        s.support_n_patients AS left_support, t.support_n_patients AS right_support, s.dispersion AS left_dispersion, t.dispersion AS right_dispersion
        FROM cohort a JOIN cohort b USING (entry_type, row_id, col_id), cohort_sum s, cohort_sum t
        WHERE a.relation_id = '{LEFT}' AND b.relation_id = '{RIGHT}' AND s.relation_id = '{LEFT}' AND t.relation_id = '{RIGHT}'""",
    "cohort cohort_sum", _CD + " left_dispersion right_dispersion",
)
def _(spark, sf):
    g = rel.gated(spark, sf)
    return stats.cohort_contrast(estimate.cohort_template(g), estimate.cohort_summary(g, K), LEFT, RIGHT)


def payload_view(name: str, pairs: str, unit: str) -> None:
    view(
        name,
        f"""SELECT {unit}, n_patients, coalesce(n_nonzero_delta, 0) AS n_nonzero_delta, support_positive_n, support_negative_n, support_zero_n, support_positive_n / n_patients AS support_positive_fraction,
            support_negative_n / n_patients AS support_negative_fraction, left_median, right_median, median_delta, mean_delta, abs(median_delta) AS abs_median_delta,
            {_DIR.format(d='median_delta')} AS contrast_direction, abs(median_delta) >= 0.05 AS effect_floor_pass, w_plus, tie_term FROM
            (SELECT {unit}, count(*) AS n_patients, count(*) FILTER (delta > 1e-12) AS support_positive_n, count(*) FILTER (delta < -1e-12) AS support_negative_n, count(*) FILTER (abs(delta) <= 1e-12) AS support_zero_n,
               median(left_value) AS left_median, median(right_value) AS right_median, median(delta) AS median_delta, avg(delta) AS mean_delta FROM {pairs} WHERE delta IS NOT NULL GROUP BY ALL)
            LEFT JOIN (SELECT {unit}, count(*) AS n_nonzero_delta, coalesce(sum(r) FILTER (delta > 0), 0) AS w_plus, CAST(sum(t * t - 1) AS DOUBLE) AS tie_term FROM
               (SELECT *, rank() OVER (PARTITION BY {unit} ORDER BY round(abs(delta), 12)) + (count(*) OVER (PARTITION BY {unit}, round(abs(delta), 12)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {unit}, round(abs(delta), 12)) AS t
                FROM {pairs} WHERE abs(delta) > 1e-12) GROUP BY ALL) USING ({unit})""",
        pairs,
    )


payload_view("family_payload", "family_contrast", "summary_name, scale")
payload_view("source_payload", "source_contrast", "source_community_id, summary_name")
payload_view("target_payload", "target_contrast", "target_community_id, summary_name")
view(
    "element_pairs",
    f"SELECT patient_id, entry_type, row_id, col_id, l.value AS left_value, r.value AS right_value, l.value - r.value AS delta FROM (SELECT * FROM gated WHERE relation_id = '{LEFT}') l JOIN (SELECT * FROM gated WHERE relation_id = '{RIGHT}') r USING (patient_id, entry_type, row_id, col_id)",
    "gated",
)
payload_view("element_payload", "element_pairs", "entry_type, row_id, col_id")
_PD = "support_positive_fraction support_negative_fraction left_median right_median median_delta mean_delta abs_median_delta w_plus tie_term"


@query("family_paired_statistics", "I12 I14", "SELECT * FROM family_payload", "family_payload", _PD)
def _(spark, sf):
    return stats.paired_payload(family_contrast(spark, sf).where("comparison_status = 'estimable'"), ["summary_name", "scale"])


@query("source_paired_statistics", "I18", "SELECT * FROM source_payload", "source_payload", _PD)
def _(spark, sf):
    return stats.paired_payload(source_contrast(spark, sf).where("comparison_status = 'estimable'"), ["source_community_id", "summary_name"])


@query("target_paired_statistics", "I18", "SELECT * FROM target_payload", "target_payload", _PD)
def _(spark, sf):
    return stats.paired_payload(target_contrast(spark, sf).where("comparison_status = 'estimable'"), ["target_community_id", "summary_name"])


@query("element_paired_statistics", "I19", "SELECT * FROM element_payload", "element_payload", _PD)
def _(spark, sf):
    return stats.paired_payload(stats.element_pairs(rel.gated(spark, sf), LEFT, RIGHT), COORD)


@query(
    "sign_tests", "I13",
    """SELECT entry_type, row_id, col_id, CASE WHEN n = 0 THEN NULL WHEN 2 * k = n THEN 1.0 ELSE least(1.0, 2 * tail / 2.0 ** n) END AS sign_test_p_value FROM
       (SELECT entry_type, row_id, col_id, any_value(n) AS n, any_value(k) AS k, sum(CASE WHEN i <= n AND i >= k THEN CAST(factorial(CAST(n AS INT)) AS DOUBLE) / factorial(CAST(i AS INT)) / factorial(CAST(greatest(n - i, 0) AS INT)) END) AS tail FROM
        (SELECT entry_type, row_id, col_id, support_positive_n + support_negative_n AS n, greatest(support_positive_n, support_negative_n) AS k FROM element_payload), range(0, 26) r(i) GROUP BY 1, 2, 3)""",
    "element_payload", "sign_test_p_value",
)
def _(spark, sf):
    payload = stats.paired_payload(stats.element_pairs(rel.gated(spark, sf), LEFT, RIGHT), COORD)
    return payload.select(*COORD, pvalues.sign_test_p("support_positive_n", "support_negative_n").alias("sign_test_p_value"))


@query("family_supplement", "I12 I13 I17 I18")
def _(spark, sf):
    return stats.paired_supplement(family_contrast(spark, sf), ["summary_name", "scale"])


@query("source_supplement", "I18")
def _(spark, sf):
    return stats.paired_supplement(source_contrast(spark, sf), ["source_community_id", "summary_name"])


@query("target_supplement", "I18")
def _(spark, sf):
    return stats.paired_supplement(target_contrast(spark, sf), ["target_community_id", "summary_name"])


@query("element_supplement", "I19")
def _(spark, sf):
    return stats.element_supplement(rel.gated(spark, sf), LEFT, RIGHT)


view(
    "given_p",
    "SELECT entry_type, row_id, col_id, effect_floor_pass, support_zero_n / 25.0 + abs_median_delta / 10 AS wilcoxon_p_value FROM element_payload",
    "element_payload",
)


@query(
    "review_flags", "I17",
    """SELECT *, coalesce(bh_q_value <= 0.05, false) AS q_pass, coalesce(bh_q_value <= 0.05, false) AND effect_floor_pass AS review_candidate FROM
       (SELECT entry_type, row_id, col_id, effect_floor_pass, wilcoxon_p_value, least(1.0, min(wilcoxon_p_value * n / r) OVER (PARTITION BY entry_type ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS bh_q_value FROM
        (SELECT *, count(*) OVER (PARTITION BY entry_type) AS n, row_number() OVER (PARTITION BY entry_type ORDER BY wilcoxon_p_value) AS r FROM given_p))""",
    "given_p", "wilcoxon_p_value bh_q_value",
)
def _(spark, sf):
    payload = stats.paired_payload(stats.element_pairs(rel.gated(spark, sf), LEFT, RIGHT), COORD)
    given = payload.select(*COORD, "effect_floor_pass", (F.col("support_zero_n") / 25.0 + F.col("abs_median_delta") / 10).alias("wilcoxon_p_value"))
    return stats.with_review_flags(given, ["entry_type"])


# --- calibration -------------------------------------------------------------


def _summaries(spark, sf, ends):
    keys = ["permutation_index", "patient_id"]
    t = estimate.gated_templates(ends, rel.identity_cost(spark, sf), rel.TAU)
    packed = summary.packed_with_burden(estimate.template_entries(t, K), ends, keys, K)
    return summary.family_summaries(packed, keys)


def real_summaries(spark, sf):
    return staged(spark, "real_summaries", sf, lambda: _summaries(spark, sf, rel.real_endpoints(spark, sf)))


def null_summaries(spark, sf):
    return staged(spark, "null_summaries", sf, lambda: _summaries(spark, sf, rel.null_endpoints(spark, sf)))


@query("null_family_summaries", "F10 H5", "SELECT * FROM fnull_family", "fnull_family", "value burden_total")
def _(spark, sf):
    return null_summaries(spark, sf)


_TAIL = "CASE WHEN summary_name = 'self_retention' THEN 'left' ELSE 'right' END"
_HIT = "CASE WHEN expected_tail = 'right' THEN round({n}, 12) >= round({r}, 12) ELSE round({n}, 12) <= round({r}, 12) END"
_OPP = "CASE WHEN expected_tail = 'left' THEN round({n}, 12) >= round({r}, 12) ELSE round({n}, 12) <= round({r}, 12) END"
_EFF = "real_value - null_reference AS effect_delta, CASE WHEN abs(null_reference) > 1e-12 THEN real_value / null_reference END AS effect_ratio, CASE WHEN abs(null_reference) <= 1e-12 THEN 'not_estimable' ELSE 'estimable' END AS effect_ratio_status"
view(
    "cal_patient",
    f"""SELECT *, {_EFF} FROM (SELECT patient_id, summary_name, scale, expected_tail, real_value, empirical_p_value, primary_tail_fraction, opposite_tail_fraction, s.stat AS reference_stat,
          CASE WHEN s.stat = 'median' THEN med ELSE mn END AS null_reference FROM
        (SELECT patient_id, summary_name, scale, expected_tail, any_value(rv) AS real_value, median(nv) AS med, avg(nv) AS mn,
           (1 + count(*) FILTER ({_HIT.format(n='nv', r='rv')})) / (1 + count(*)) AS empirical_p_value, count(*) FILTER ({_HIT.format(n='nv', r='rv')}) / count(*) AS primary_tail_fraction,
           count(*) FILTER ({_OPP.format(n='nv', r='rv')}) / count(*) AS opposite_tail_fraction FROM
         (SELECT patient_id, summary_name, scale, n.value AS nv, r.value AS rv, {_TAIL} AS expected_tail FROM fnull_family n JOIN (SELECT patient_id, summary_name, scale, value FROM freal_family) r USING (patient_id, summary_name, scale)) GROUP BY 1, 2, 3, 4)
        CROSS JOIN (VALUES ('median'), ('mean')) s(stat))""",
    "fnull_family", "freal_family",
)
_CALD = "real_value empirical_p_value primary_tail_fraction opposite_tail_fraction null_reference effect_delta effect_ratio"


@query("patient_calibration", "I20 I21 I22 I23", "SELECT * FROM cal_patient", "cal_patient", _CALD)
def _(spark, sf):
    return stats.patient_calibration(real_summaries(spark, sf), null_summaries(spark, sf))


@query(
    "cohort_calibration", "I24",
    f"""SELECT *, {_EFF} FROM (SELECT summary_name, scale, reference_stat, expected_tail, any_value(rv) AS real_value, CASE WHEN reference_stat = 'median' THEN median(nv) ELSE avg(nv) END AS null_reference,
          (1 + count(*) FILTER ({_HIT.format(n='nv', r='rv')})) / (1 + count(*)) AS empirical_p_value, count(*) FILTER ({_HIT.format(n='nv', r='rv')}) / count(*) AS primary_tail_fraction,
          count(*) FILTER ({_OPP.format(n='nv', r='rv')}) / count(*) AS opposite_tail_fraction FROM
        (SELECT summary_name, scale, reference_stat, {_TAIL} AS expected_tail, n.v AS nv, r.v AS rv FROM
          (SELECT summary_name, scale, permutation_index, 'median' AS reference_stat, median(value) AS v FROM fnull_family GROUP BY 1, 2, 3 UNION ALL SELECT summary_name, scale, permutation_index, 'mean', avg(value) FROM fnull_family GROUP BY 1, 2, 3) n
          JOIN (SELECT summary_name, scale, 'median' AS reference_stat, median(value) AS v FROM freal_family GROUP BY 1, 2 UNION ALL SELECT summary_name, scale, 'mean', avg(value) FROM freal_family GROUP BY 1, 2) r USING (summary_name, scale, reference_stat)) GROUP BY 1, 2, 3, 4)
        JOIN (SELECT summary_name, scale, reference_stat, count(*) FILTER (effect_delta > 1e-12) AS n_patient_delta_positive, count(*) FILTER (effect_delta < -1e-12) AS n_patient_delta_negative,
          count(*) FILTER (abs(effect_delta) <= 1e-12) AS n_patient_delta_zero FROM cal_patient GROUP BY 1, 2, 3) USING (summary_name, scale, reference_stat)""",
    "fnull_family freal_family cal_patient", _CALD,
)
def _(spark, sf):
    return stats.cohort_calibration(real_summaries(spark, sf), null_summaries(spark, sf))


@query(
    "incomplete_calibration", "B21",
    f"""SELECT patient_id, n_real, n_indices, n_outside, n_repeated FROM (SELECT patient_id, count(*) AS n_real FROM freal_src WHERE state_id = 0 AND patient_id NOT IN (SELECT patient_id FROM real_endpoints WHERE state_id = 1 AND x < 0.18) GROUP BY 1) r
        FULL JOIN (SELECT patient_id, count(*) FILTER (permutation_index BETWEEN 0 AND {rel.N_PERM - 1}) AS n_indices, count(*) FILTER (permutation_index NOT BETWEEN 0 AND {rel.N_PERM - 1}) AS n_outside, 0 AS n_repeated
          FROM fnull_src WHERE state_id = 0 AND NOT (permutation_index = 2 AND x < 0.19) GROUP BY 1) n USING (patient_id)
        WHERE NOT coalesce(n_real = 1 AND n_indices = {rel.N_PERM} AND n_outside = 0, false)""",
    "freal_src fnull_src real_endpoints",
)
def _(spark, sf):
    x = lambda k: F.get("x", F.lit(k))
    real = rel.real_endpoints(spark, sf).where(x(1) >= 0.18)
    null = rel.null_endpoints(spark, sf).where(~((F.col("permutation_index") == 2) & (x(0) < 0.19)))
    return quality.incomplete_calibration(real, null, rel.N_PERM)


# --- recovery ----------------------------------------------------------------
# Truth: each patient's filled gated template. Methods: the diagonal plan, the
# cohort mean for everybody, and a blend of truth and cohort mean as reference.

REF = "blend"
view(
    "methods",
    """SELECT relation_id, patient_id, 'diagonal' AS method_name, entry_type, row_id, col_id, value FROM diag
       UNION ALL SELECT g.relation_id, g.patient_id, 'cohort_mean', entry_type, row_id, col_id, c.value FROM gated g JOIN cohort c USING (relation_id, entry_type, row_id, col_id)
       UNION ALL SELECT g.relation_id, g.patient_id, 'blend', entry_type, row_id, col_id, (g.value + c.value) / 2 FROM gated g JOIN cohort c USING (relation_id, entry_type, row_id, col_id)""",
    "diag", "gated", "cohort",
)
view(
    "rec",
    f"""SELECT relation_id, patient_id, method_name, entry_type, row_id, col_id, CASE WHEN entry_type = 'e' THEN 1 ELSE e.x END AS w, e.x > 1e-12 AS active,
        CASE WHEN entry_type = 'e' THEN 1 ELSE e.x END * t.value AS tv, CASE WHEN entry_type = 'e' THEN 1 ELSE e.x END * m.value AS mv FROM gated t JOIN methods m USING (relation_id, patient_id, entry_type, row_id, col_id)
        LEFT JOIN (SELECT relation_id, patient_id, state_id AS row_id, x FROM endpoints) e USING (relation_id, patient_id, row_id)""",
    "gated", "methods", "endpoints",
)
_MK = "relation_id, patient_id, method_name"
view(
    "rec_open",
    f"""SELECT {_MK}, entry_type, CASE WHEN entry_type = 'd' THEN row_id ELSE col_id END AS k, tv, mv FROM rec WHERE entry_type <> 'A'""",
    "rec",
)
for _side in ("t", "m"):
    view(
        f"sup_{_side}",
        f"""SELECT {_MK}, entry_type, k FROM (SELECT *, sum({_side}v) OVER (PARTITION BY {_MK}, entry_type) AS tot,
            coalesce(sum({_side}v) OVER (PARTITION BY {_MK}, entry_type ORDER BY {_side}v DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM rec_open) WHERE tot > 1e-12 AND prev / tot < 0.95 - 1e-12""",
        "rec_open",
    )
view(
    "f1",
    f"""SELECT {_MK}, avg(f) AS open_support_f1 FROM (SELECT {_MK}, entry_type, CASE WHEN nt = 0 AND nm = 0 THEN 1.0 WHEN nb = 0 THEN 0.0 ELSE 2.0 * nb / (nt + nm) END AS f FROM
        (SELECT o.relation_id, o.patient_id, o.method_name, o.entry_type, count(a.k) AS nt, count(b.k) AS nm, count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) AS nb FROM rec_open o
         LEFT JOIN sup_t a USING ({_MK}, entry_type, k) LEFT JOIN sup_m b USING ({_MK}, entry_type, k) GROUP BY ALL)) GROUP BY ALL""",
    "rec_open", "sup_t", "sup_m",
)
view(
    "recall",
    f"""SELECT {_MK}, count(*) FILTER (is_true AND rn <= nt) / nullif(any_value(nt), 0) AS target_recall_at_k FROM
        (SELECT *, row_number() OVER (PARTITION BY {_MK} ORDER BY ms DESC, col_id) AS rn, count(*) FILTER (is_true) OVER (PARTITION BY {_MK}) AS nt FROM
         (SELECT {_MK}, col_id, sum(CASE WHEN row_id <> col_id THEN mv ELSE 0 END) AS ms, sum(CASE WHEN row_id <> col_id THEN tv ELSE 0 END) > 1e-12 AS is_true FROM rec WHERE entry_type = 'A' GROUP BY ALL)) GROUP BY ALL""",
    "rec",
)
view(
    "endp",
    f"""SELECT {_MK}, avg(abs(y - p)) AS endpoint_y_mae FROM (SELECT {_MK}, y, raw / sum(raw) OVER (PARTITION BY {_MK}) AS p FROM
        (SELECT {_MK}, col_id AS state_id, sum(mv) AS raw FROM rec WHERE entry_type <> 'd' GROUP BY ALL) JOIN endpoints USING (relation_id, patient_id, state_id)) GROUP BY ALL""",
    "rec", "endpoints",
)
view(
    "rec_wide",
    f"""SELECT {_MK}, f_l1_total, g_l1_total, e_l1_total, abs(om - ot) AS offdiag_mass_abs_error, abs(dm - dt) AS depletion_mass_abs_error, abs(em - et) AS emergence_mass_abs_error,
        CASE WHEN ot > 1e-12 THEN om / ot END AS offdiag_ratio, CASE WHEN dt > 1e-12 THEN dm / dt END AS depletion_capture, CASE WHEN et > 1e-12 THEN em / et END AS emergence_capture,
        endpoint_y_mae, coalesce(a_mae_active, 0) AS a_mae_active, coalesce(a_mse_active, 0) AS a_mse_active, target_recall_at_k, open_support_f1,
        g_l1_total / {K} AS d_mae, d2 / {K} AS d_mse, e_l1_total / {K} AS e_mae, e2 / {K} AS e_mse, dt + et AS open_mass FROM
        (SELECT {_MK}, sum(abs(mv - tv)) FILTER (entry_type = 'A') AS f_l1_total, sum(abs(mv - tv)) FILTER (entry_type = 'd') AS g_l1_total, sum(abs(mv - tv)) FILTER (entry_type = 'e') AS e_l1_total,
          sum((mv - tv) ** 2) FILTER (entry_type = 'd') AS d2, sum((mv - tv) ** 2) FILTER (entry_type = 'e') AS e2,
          avg(abs(mv - tv)) FILTER (entry_type = 'A' AND active) AS a_mae_active, avg((mv - tv) ** 2) FILTER (entry_type = 'A' AND active) AS a_mse_active,
          sum(tv) FILTER (entry_type = 'A' AND row_id <> col_id) AS ot, sum(mv) FILTER (entry_type = 'A' AND row_id <> col_id) AS om, sum(tv) FILTER (entry_type = 'd') AS dt, sum(mv) FILTER (entry_type = 'd') AS dm,
          sum(tv) FILTER (entry_type = 'e') AS et, sum(mv) FILTER (entry_type = 'e') AS em FROM rec GROUP BY ALL) JOIN f1 USING ({_MK}) JOIN recall USING ({_MK}) JOIN endp USING ({_MK})""",
    "rec", "f1", "recall", "endp",
)
view(
    "rec_rows",
    " UNION ALL ".join(f"SELECT {_MK}, '{m}' AS metric_name, {m} AS value, CASE WHEN {m} IS NULL THEN 'not_applicable' ELSE 'reported' END AS status FROM rec_wide" for m in recovery.MASS_METRICS),
    "rec_wide",
)


def methods(spark, sf):
    g = rel.gated(spark, sf)
    cohort = estimate.cohort_template(g).select("relation_id", *COORD, F.col("value").alias("c"))
    both = g.join(F.broadcast(cohort), ["relation_id", *COORD])
    item = F.array(
        F.struct(F.lit("cohort_mean").alias("method_name"), F.col("c").alias("v")),
        F.struct(F.lit(REF).alias("method_name"), ((F.col("value") + F.col("c")) / 2).alias("v")),
    )
    shared = both.select(*RK, *COORD, F.inline(item)).withColumnRenamed("v", "value")
    return rel.diagonal(spark, sf).withColumn("method_name", F.lit("diagonal")).unionByName(shared)


def recovery_wide(spark, sf):
    def build():
        packed = recovery.pack_recovery(rel.gated(spark, sf), methods(spark, sf), rel.endpoints(spark, sf), RK, ["method_name"], K)
        return recovery.recovery_wide(packed)

    return staged(spark, "recovery", sf, build)


@query("recovery_errors", "I27", "SELECT * FROM rec_rows", "rec_rows", "value")
def _(spark, sf):
    return recovery.metric_rows(recovery_wide(spark, sf), recovery.MASS_METRICS)


@query("target_recall", "I28", "SELECT * FROM recall", "recall", "target_recall_at_k")
def _(spark, sf):
    return recovery_wide(spark, sf).select(*RK, "method_name", "target_recall_at_k")


@query("coverage_support", "I29", f"SELECT {_MK}, entry_type, k FROM sup_m", "sup_m")
def _(spark, sf):
    packed = recovery.pack_recovery(rel.gated(spark, sf), methods(spark, sf), rel.endpoints(spark, sf), RK, ["method_name"], K)
    burden = F.zip_with("dh", "x", lambda d, x: d * x)
    both = packed.withColumn("d", recovery.coverage_support(burden)).withColumn("e", recovery.coverage_support(F.col("eh")))
    parts = [both.select(*RK, "method_name", F.lit(t).alias("entry_type"), F.explode(t).alias("k")) for t in ("d", "e")]
    return parts[0].unionByName(parts[1])


@query("open_support_f1", "I30", "SELECT * FROM f1", "f1", "open_support_f1")
def _(spark, sf):
    return recovery_wide(spark, sf).select(*RK, "method_name", "open_support_f1")


@query(
    "open_metric_rows", "I31",
    " UNION ALL ".join(
        f"SELECT {_MK}, '{m}' AS metric_name, {v} AS value, CASE WHEN {v} IS NULL THEN 'not_applicable' ELSE 'reported' END AS status FROM rec_wide"
        for m in recovery.OPEN_METRICS for v in [f"CASE WHEN open_mass > 1e-12 THEN {m} END" if m == "open_support_f1" else m]
    ),
    "rec_wide", "value",
)
def _(spark, sf):
    return recovery.metric_rows(recovery_wide(spark, sf), recovery.OPEN_METRICS, open_only=True)


# Held-out patients of every rerun carry the metric rows of that rerun.
view("rerun_rows", "SELECT s.rerun_index AS rerun_id, r.relation_id AS condition_id, r.patient_id, r.method_name, r.metric_name, r.value, r.status FROM rec_rows r JOIN splits s USING (patient_id) WHERE s.split = 'test'", "rec_rows", "splits")
_CELL = "condition_id, method_name, metric_name"
view("rerun_means", f"SELECT {_CELL}, rerun_id, avg(value) AS m FROM rerun_rows WHERE status = 'reported' GROUP BY ALL", "rerun_rows")


def _draw_sql(seed: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST(('0x' || substr(sha256({text}), 1, 8)) AS BIGINT)"


view(
    "rerun_boot",
    f"""SELECT {_CELL}, any_value(mm) AS mean_value, quantile_cont(bm, 0.025) AS ci_lower, quantile_cont(bm, 0.975) AS ci_upper FROM
        (SELECT {_CELL}, r.range AS rep, any_value(mm) AS mm, avg(v[{_draw_sql('17', 'r.range', 's.range')} % len(v) + 1]) AS bm FROM
         (SELECT {_CELL}, list(m ORDER BY rerun_id) AS v, avg(m) AS mm FROM rerun_means GROUP BY ALL), range(256) r, range(1, 26) s WHERE s.range <= len(v) GROUP BY ALL) GROUP BY ALL""".replace("GROUP BY ALL) GROUP BY ALL", f"GROUP BY {_CELL}, r.range) GROUP BY {_CELL}"),
    "rerun_means",
)


def rerun_rows(spark, sf):
    rows = recovery.metric_rows(recovery_wide(spark, sf), recovery.MASS_METRICS)
    held = rel.splits(spark, sf).where("split = 'test'").select("patient_id", F.col("rerun_index").alias("rerun_id"))
    return rows.join(held, "patient_id").withColumnRenamed("relation_id", "condition_id")


@query("mean_intervals", "I33", "SELECT * FROM rerun_boot", "rerun_boot", "mean_value ci_lower ci_upper")
def _(spark, sf):
    cell = ["condition_id", "method_name", "metric_name"]
    reruns = rerun_rows(spark, sf).where("status = 'reported'").groupBy(*cell, "rerun_id").agg(F.avg("value").alias("m"))
    return resampling.mean_interval(reruns, cell, "rerun_id", "m")


view(
    "cond_sum",
    f"""SELECT {_CELL}, CASE WHEN s.st = 'reported' AND coalesce(f.st, '') <> 'reported' THEN 'not_estimable' ELSE s.st END AS status,
        CASE WHEN s.st = 'reported' AND f.st = 'reported' THEN mean_value END AS mean_value, CASE WHEN s.st = 'reported' AND f.st = 'reported' THEN ci_lower END AS ci_lower,
        CASE WHEN s.st = 'reported' AND f.st = 'reported' THEN ci_upper END AS ci_upper, CASE WHEN s.st = 'reported' AND f.st = 'reported' THEN diff END AS paired_difference FROM
        (SELECT {_CELL}, CASE WHEN bool_or(status = 'not_estimable') THEN 'not_estimable' WHEN bool_or(status = 'not_applicable') AND bool_or(status = 'reported') THEN 'mixed_error' WHEN bool_or(status = 'not_applicable') THEN 'not_applicable' ELSE 'reported' END AS st FROM rerun_rows GROUP BY 1, 2, 3) s
        LEFT JOIN rerun_boot USING ({_CELL}) LEFT JOIN (SELECT {_CELL}, avg(a.m - b.m) AS diff FROM rerun_means a JOIN (SELECT condition_id, metric_name, rerun_id, m FROM rerun_means WHERE method_name = '{REF}') b USING (condition_id, metric_name, rerun_id) GROUP BY 1, 2, 3) USING ({_CELL})
        LEFT JOIN (SELECT condition_id, metric_name, CASE WHEN bool_or(status = 'not_estimable') THEN 'not_estimable' WHEN bool_or(status = 'not_applicable') AND bool_or(status = 'reported') THEN 'mixed_error' WHEN bool_or(status = 'not_applicable') THEN 'not_applicable' ELSE 'reported' END AS st
          FROM rerun_rows WHERE method_name = '{REF}' GROUP BY 1, 2) f USING (condition_id, metric_name)""",
    "rerun_rows", "rerun_boot", "rerun_means",
)
_SUMD = "mean_value ci_lower ci_upper paired_difference"


def condition_summary(spark, sf):
    return resampling.condition_summary(rerun_rows(spark, sf), REF)


@query("condition_summary", "I32", "SELECT * FROM cond_sum", "cond_sum", _SUMD)
def _(spark, sf):
    return condition_summary(spark, sf)


@query(
    "review_rows", "I44",
    "SELECT c.*, r.source_domain AS section_title, r.target_domain AS condition_title FROM cond_sum c JOIN relations r ON r.relation_id = c.condition_id", "cond_sum relations", _SUMD,
)
def _(spark, sf):
    labels = base.relations(spark).select(F.col("relation_id").alias("condition_id"), F.col("source_domain").alias("section_title"), F.col("target_domain").alias("condition_title"))
    return resampling.review_rows(condition_summary(spark, sf), labels)


# --- profiles ----------------------------------------------------------------
# Real profile: y of held-out patients; synthetic: their predicted target x A + e.

view(
    "profiles",
    """SELECT rerun_index, relation_id, patient_id, state_id, y, raw / sum(raw) OVER (PARTITION BY rerun_index, relation_id, patient_id) AS syn, x FROM
       (SELECT s.rerun_index, m.relation_id, m.patient_id, m.col_id AS state_id, sum(CASE WHEN m.entry_type = 'A' THEN e.x * m.value ELSE m.value END) AS raw FROM methods m
        JOIN (SELECT * FROM splits WHERE split = 'test') s USING (patient_id) LEFT JOIN (SELECT relation_id, patient_id, state_id AS row_id, x FROM endpoints) e USING (relation_id, patient_id, row_id)
        WHERE method_name = 'cohort_mean' AND entry_type <> 'd' GROUP BY 1, 2, 3, 4) JOIN endpoints USING (relation_id, patient_id, state_id)""",
    "methods", "splits", "endpoints",
)
view(
    "surfaces",
    """SELECT rerun_index, relation_id, state_id, r / sum(r) OVER w AS real_profile, s / sum(s) OVER w AS synthetic_profile FROM (SELECT rerun_index, relation_id, state_id, avg(y) AS r, avg(syn) AS s FROM profiles GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY rerun_index, relation_id)""",
    "profiles",
)
RR = ["rerun_index", "relation_id"]


def profiles(spark, sf):
    """Held-out patients with x, y and the synthetic target profile, as arrays."""
    m = methods(spark, sf).where("method_name = 'cohort_mean'").drop("method_name")
    ep = rel.endpoints(spark, sf)
    held = rel.splits(spark, sf).where("split = 'test'").select("rerun_index", "patient_id")
    syn = estimate.predict_targets(ep.withColumn("fractions", F.col("x")), m, RK, K).select(*RK, F.col("predicted").alias("syn"))
    return staged(spark, "profiles", sf, lambda: ep.join(syn, RK).join(held, "patient_id"))


def surfaces(spark, sf):
    p = profiles(spark, sf)
    return recovery.mean_profiles(p, RR, "y", K, "real_profile").join(recovery.mean_profiles(p, RR, "syn", K, "synthetic_profile"), RR)


@query("profile_surfaces", "I35 E7", "SELECT * FROM surfaces", "surfaces", "real_profile synthetic_profile")
def _(spark, sf):
    s = surfaces(spark, sf)
    return s.select(*RR, F.posexplode(F.arrays_zip("real_profile", "synthetic_profile")).alias("state_id", "p")).select(*RR, "state_id", "p.real_profile", "p.synthetic_profile")


@query(
    "real_vs_synthetic_profiles", "I35",
    "SELECT rerun_index, relation_id, patient_id, state_id, 'heldout_real' AS surface_source, y AS value FROM profiles UNION ALL SELECT rerun_index, relation_id, patient_id, state_id, 'synthetic', syn FROM profiles",
    "profiles", "value",
)
def _(spark, sf):
    p = profiles(spark, sf)
    one = lambda c, name: p.select(*RR, "patient_id", F.posexplode(c).alias("state_id", "value")).withColumn("surface_source", F.lit(name))
    return one("y", "heldout_real").unionByName(one("syn", "synthetic"))


@query(
    "projected_profiles", "I35",
    "SELECT rerun_index, relation_id, cell_subtype_label, sum(synthetic_profile * g) AS value FROM surfaces JOIN idvec USING (state_id) GROUP BY 1, 2, 3", "surfaces idvec", "value",
)
def _(spark, sf):
    out = recovery.project_profiles(surfaces(spark, sf), "synthetic_profile", rel.identity(spark, sf), "projected")
    names = F.array(*[F.lit(t) for t in base.SUBTYPES])
    zipped = F.arrays_zip(names.alias("cell_subtype_label"), F.col("projected").alias("value"))
    return out.select(*RR, F.inline(zipped)).toDF(*RR, "cell_subtype_label", "value")


def metric_sql(source: str, keys: str, a: str, b: str) -> str:
    return f"""SELECT {keys}, CASE WHEN max(abs(pa - ma)) <= 1e-12 OR max(abs(pb - mb)) <= 1e-12 THEN NULL ELSE greatest(-1, least(1, sum((pa - ma) * (pb - mb)) / sqrt(sum((pa - ma) ** 2) * sum((pb - mb) ** 2)))) END AS pearson,
        avg(abs(pa - pb)) AS mae, avg((pa - pb) ** 2) AS mse, sum(CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) ELSE 0 END) / 2 AS js_divergence,
        CASE WHEN bool_or(pa > 0 AND pb <= 0) THEN NULL ELSE sum(CASE WHEN pa > 0 AND pb > 0 THEN pa * ln(pa / pb) ELSE 0 END) END AS kl_divergence FROM
        (SELECT *, avg(pa) OVER (PARTITION BY {keys}) AS ma, avg(pb) OVER (PARTITION BY {keys}) AS mb FROM (SELECT {keys}, {a} / sum({a}) OVER (PARTITION BY {keys}) AS pa, {b} / sum({b}) OVER (PARTITION BY {keys}) AS pb FROM {source})) GROUP BY {keys}"""


view("surface_metrics", metric_sql("surfaces", "rerun_index, relation_id", "real_profile", "synthetic_profile"), "surfaces")
_MET = "pearson mae mse js_divergence kl_divergence"


@query("profile_metrics", "I25", "SELECT * FROM surface_metrics", "surface_metrics", _MET)
def _(spark, sf):
    return recovery.profile_metrics(surfaces(spark, sf), "real_profile", "synthetic_profile").select(*RR, *_MET.split())


@query(
    "profile_deviation", "I26",
    """SELECT rerun_index, relation_id, median(tv) AS median_tv_deviation FROM (SELECT p.rerun_index, p.relation_id, patient_id, sum(abs(p.syn - s.synthetic_profile)) / 2 AS tv FROM profiles p
       JOIN surfaces s USING (rerun_index, relation_id, state_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "profiles surfaces", "median_tv_deviation",
)
def _(spark, sf):
    return recovery.deviation_from_centroid(profiles(spark, sf), RR, "syn", K)


@query(
    "rerun_variability", "I34",
    """SELECT relation_id, object_variability, metric_variability, object_variability + metric_variability AS rerun_variability FROM
       (SELECT relation_id, avg(s) AS object_variability FROM (SELECT relation_id, state_id, stddev_pop(synthetic_profile) AS s FROM surfaces GROUP BY 1, 2) GROUP BY 1)
       JOIN (SELECT relation_id, (stddev_pop(pearson) + stddev_pop(mae) + stddev_pop(mse) + stddev_pop(js_divergence)) / 4 AS metric_variability FROM surface_metrics GROUP BY 1) USING (relation_id)""",
    "surfaces surface_metrics", "object_variability metric_variability rerun_variability",
)
def _(spark, sf):
    s = surfaces(spark, sf)
    prof = s.select("relation_id", F.posexplode("synthetic_profile").alias("position", "value"))
    m = recovery.profile_metrics(s, "real_profile", "synthetic_profile")
    names = ["pearson", "mae", "mse", "js_divergence"]
    long = m.select("relation_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).alias("value")) for n in names])))
    return resampling.rerun_variability(prof, long, ["relation_id"])


# --- bootstrap ---------------------------------------------------------------

B_REP, B_SEED = 16, "42"
view(
    "boot_rows",
    f"SELECT relation_id, patient_id, row_number() OVER (PARTITION BY relation_id ORDER BY sha256('{B_SEED}|' || patient_id)) AS slot, count(*) OVER (PARTITION BY relation_id) AS n FROM (SELECT DISTINCT relation_id, patient_id FROM endpoints)",
    "endpoints",
)
view(
    "boot_w",
    f"""SELECT relation_id, replicate, patient_id, weight, n FROM (SELECT relation_id, CAST(r.range AS INT) AS replicate, {_draw_sql(B_SEED, 'r.range', 'slot')} % n + 1 AS slot, count(*) AS weight FROM boot_rows, range({B_REP}) r GROUP BY 1, 2, 3)
        JOIN boot_rows USING (relation_id, slot)""",
    "boot_rows",
)
view("boot_mean", "SELECT relation_id, replicate, entry_type, row_id, col_id, sum(value * weight) / any_value(n) AS value FROM gated JOIN boot_w USING (relation_id, patient_id) GROUP BY 1, 2, 3, 4, 5", "gated", "boot_w")


def boot_weights(spark, sf):
    units = rel.endpoints(spark, sf).select(*RK)
    return staged(spark, "boot_weights", sf, lambda: resampling.resample_weights(units, ["relation_id"], "patient_id", B_REP, B_SEED))


def boot_means(spark, sf):
    return resampling.resampled_means(rel.gated(spark, sf), boot_weights(spark, sf))


@query("patient_bootstrap", "I36", "SELECT * FROM boot_w", "boot_w")
def _(spark, sf):
    return boot_weights(spark, sf)


@query("bootstrap_replicates", "I36", "SELECT * FROM boot_mean", "boot_mean", "value")
def _(spark, sf):
    return boot_means(spark, sf)


@query(
    "bootstrap_stability", "I37",
    "SELECT relation_id, entry_type, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / nullif(avg(value), 0) AS cv FROM boot_mean GROUP BY 1, 2", "boot_mean", "mean sd cv",
)
def _(spark, sf):
    return resampling.stability(boot_means(spark, sf), ["relation_id", "entry_type"], "value")


view(
    "boot_sum",
    "SELECT relation_id, entry_type, row_id, col_id, avg(b.value) AS mean, stddev_samp(b.value) AS sd, avg(CASE WHEN abs(b.value) > 1e-12 THEN 1 ELSE 0 END) AS nonzero_frequency, sum(abs(b.value - c.value)) AS gap_sum, max(abs(b.value - c.value)) AS gap_max, count(*) AS n FROM boot_mean b JOIN cohort c USING (relation_id, entry_type, row_id, col_id) GROUP BY 1, 2, 3, 4",
    "boot_mean", "cohort",
)


@query("bootstrap_entry_summary", "I38", "SELECT * FROM boot_sum", "boot_sum", "mean sd nonzero_frequency gap_sum gap_max")
def _(spark, sf):
    return resampling.bootstrap_entry_summary(boot_means(spark, sf), estimate.cohort_template(rel.gated(spark, sf)))


@query(
    "bootstrap_overall", "I38",
    "SELECT relation_id, entry_type, sum(gap_sum) / sum(n) AS mean_abs_deviation, max(gap_max) AS max_abs_deviation, avg(sd) AS mean_element_std FROM boot_sum GROUP BY 1, 2",
    "boot_sum", "mean_abs_deviation max_abs_deviation mean_element_std",
)
def _(spark, sf):
    return resampling.bootstrap_overall(resampling.bootstrap_entry_summary(boot_means(spark, sf), estimate.cohort_template(rel.gated(spark, sf))))


view(
    "boot_patients",
    """SELECT relation_id, patient_id, fit_status <> 'deferred' AS eligible, fit_status AS uncertainty_status, coalesce(rate, 0) AS success_rate, v AS "A_std", v / 2 AS d_std, v / 4 AS e_std FROM fits
       LEFT JOIN (SELECT relation_id, patient_id, count(DISTINCT replicate) / 16.0 AS rate FROM boot_w GROUP BY 1, 2) USING (relation_id, patient_id)
       LEFT JOIN (SELECT relation_id, patient_id, sum(least(x, y)) AS v FROM endpoints GROUP BY 1, 2) USING (relation_id, patient_id)""",
    "fits", "boot_w", "endpoints",
)


@query(
    "cohort_bootstrap_summary", "I39",
    """SELECT count(*) AS n_patients, count(*) FILTER (eligible) AS n_eligible_patients, count(*) FILTER (uncertainty_status = 'ok') AS n_realized_patients, count(*) FILTER (uncertainty_status = 'deferred') AS n_deferred,
       count(*) FILTER (uncertainty_status = 'failed') AS n_failed, avg(success_rate) FILTER (eligible) AS mean_patient_success_rate, avg("A_std") FILTER (uncertainty_status = 'ok') AS "mean_A_std",
       avg(d_std) FILTER (uncertainty_status = 'ok') AS mean_d_std, avg(e_std) FILTER (uncertainty_status = 'ok') AS mean_e_std, CASE WHEN bool_or(uncertainty_status = 'ok') THEN 'ok' WHEN bool_or(eligible AND uncertainty_status = 'failed') THEN 'failed' ELSE 'deferred' END AS uncertainty_status FROM boot_patients""",
    "boot_patients", "mean_patient_success_rate mean_A_std mean_d_std mean_e_std",
)
def _(spark, sf):
    rate = boot_weights(spark, sf).groupBy(*RK).agg((F.count(F.lit(1)) / B_REP).alias("rate"))
    v = estimate.endpoint_overlap(rel.endpoints(spark, sf)).withColumnRenamed("overlap", "v")
    patients = rel.fits(spark, sf).join(rate, RK, "left").join(v, RK, "left").select(
        *RK, (F.col("fit_status") != "deferred").alias("eligible"), F.col("fit_status").alias("uncertainty_status"), F.coalesce("rate", F.lit(0.0)).alias("success_rate"),
        F.col("v").alias("A_std"), (F.col("v") / 2).alias("d_std"), (F.col("v") / 4).alias("e_std"),
    )
    return resampling.cohort_bootstrap_summary(patients)


@query(
    "log_measurement_error", "I40",
    """SELECT relation_id, entry_type, row_id, col_id, count(*) AS n, 0 AS n_negative, greatest(var_samp(ln(value + 1e-4)), 1e-6) AS log_variance, var_samp(ln(value + 1e-4)) < 1e-6 AS floor_applied FROM boot_mean GROUP BY 1, 2, 3, 4""",
    "boot_mean", "log_variance",
)
def _(spark, sf):
    return resampling.log_error(boot_means(spark, sf), ["relation_id", *COORD], "value")


@query(
    "weighted_quantiles", "I41",
    f"""SELECT domain_label, CASE WHEN 0.4 <= c[1] THEN v[1] WHEN 0.4 >= c[len(c)] THEN v[len(v)] ELSE v[i] + (v[i + 1] - v[i]) * (0.4 - c[i]) / (c[i + 1] - c[i]) END AS weighted_quantile FROM
        (SELECT *, len([z FOR z IN c IF z <= 0.4]) AS i FROM (SELECT domain_label, list(fraction ORDER BY fraction, w) AS v, list(c ORDER BY fraction, w) AS c FROM
          (SELECT domain_label, fraction, n_all AS w, (sum(n_all) OVER (PARTITION BY domain_label ORDER BY fraction, n_all ROWS UNBOUNDED PRECEDING) - 0.5 * n_all) / sum(n_all) OVER (PARTITION BY domain_label) AS c FROM
           (SELECT c.domain_label, c.fraction, f.n_cells AS n_all FROM comp c JOIN fovs f USING (patient_id, timepoint, fov_id))) GROUP BY 1))""",
    "comp fovs", "weighted_quantile",
)
def _(spark, sf):
    comp = base.composition(spark, sf)
    weighted = comp.join(base.fovs(spark, sf).select("patient_id", "timepoint", "fov_id", F.col("n_cells").cast("double").alias("w")), ["patient_id", "timepoint", "fov_id"])
    return resampling.weighted_quantile(weighted, ["domain_label"], "fraction", "w", 0.4)


@query(
    "panel_matches", "I43",
    """SELECT s.relation_id, s.group_id, s.n_patients, coalesce(p.n, 0) AS n_panels, CASE WHEN p.n = 1 THEN 'ok' WHEN p.n IS NULL THEN 'no_panel' ELSE 'ambiguous' END AS match_status FROM
       (SELECT relation_id, group_id, count(*) AS n_patients FROM (SELECT DISTINCT relation_id, patient_id FROM endpoints) JOIN grps USING (patient_id) GROUP BY 1, 2) s
       LEFT JOIN (SELECT relation_id, group_id, count(*) AS n FROM fits JOIN grps USING (patient_id) WHERE fit_status = 'deferred' GROUP BY 1, 2) p USING (relation_id, group_id)""",
    "endpoints grps fits",
)
def _(spark, sf):
    g = base.groups(spark, sf)
    ext = rel.endpoints(spark, sf).select(*RK).join(g, "patient_id").groupBy("relation_id", "group_id").agg(F.count(F.lit(1)).alias("n_patients"))
    panels = rel.fits(spark, sf).where("fit_status = 'deferred'").join(g, "patient_id")
    return stats.panel_matches(ext, panels, ["relation_id", "group_id"])


@query(
    "fraction_report", "A16",
    """SELECT 'fov_mean' AS scale, relation_id, group_id AS "group", patient_id, side, state_id AS community_id, 'C' || state_id AS community_label, fraction,
       CAST(NULL AS DOUBLE) AS p_value, CAST(NULL AS DOUBLE) AS q_value, CAST(NULL AS VARCHAR) AS test_name, CAST(NULL AS VARCHAR) AS correction_method FROM side_means LEFT JOIN grps USING (patient_id)""",
    "side_means grps", "fraction",
)
def _(spark, sf):
    table = compose.with_groups(compose.side_means(base.composition(spark, sf), base.sides(spark)), base.groups(spark, sf))
    null = lambda t: F.lit(None).cast(t)
    return fraction_report(
        table.select(
            F.lit("fov_mean").alias("scale"), "relation_id", F.col("group_id").alias("group"), "patient_id", "side", F.col("state_id").alias("community_id"),
            F.concat(F.lit("C"), F.col("state_id").cast("string")).alias("community_label"), "fraction", null("double").alias("p_value"), null("double").alias("q_value"),
            null("string").alias("test_name"), null("string").alias("correction_method"),
        )
    )
