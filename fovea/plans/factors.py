"""Catalog: relation programs.

The tables are checked on factors that follow directly from the data: patient
loadings from the source vectors, source and target loadings from the cohort
template, and a fixed rank-sized core.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import estimate, programs, quality, stats
from fovea.plans import base
from fovea.plans import relations as rel
from fovea.plans.base import K, LEFT
from fovea.plans.catalog import query, view
from fovea.plans.statistics import comparisons
from fovea.runtime import staged
from fovea.sources import sinks

RK = ["relation_id", "patient_id"]
R1, R2, R3 = 2, 2, 3

view("tensor", "SELECT relation_id, patient_id, entry_type, row_id, col_id, value FROM gated WHERE entry_type <> 'e'", "gated")
view("pf", f"SELECT relation_id, patient_id, state_id AS factor_id, x AS loading FROM endpoints WHERE state_id < {R1}", "endpoints")
view("sfac", f"SELECT relation_id, row_id AS axis_id, col_id AS factor_id, value AS loading FROM cohort WHERE entry_type = 'A' AND col_id < {R2}", "cohort")
view(
    "tfac",
    f"SELECT relation_id, col_id AS axis_id, row_id AS factor_id, CASE WHEN row_id = 2 AND relation_id = '{LEFT}' THEN 0 ELSE value END AS loading FROM cohort WHERE entry_type <> 'e' AND row_id < {R3}",
    "cohort",
)
view(
    "core",
    f"SELECT DISTINCT relation_id, CAST(a.range AS INT) AS patient_factor_id, CAST(b.range AS INT) AS source_factor_id, CAST(c.range AS INT) AS target_open_factor_id, (1.0 + a.range + 2 * b.range * c.range) AS weight FROM cohort, range({R1}) a, range({R2}) b, range({R3}) c",
    "cohort",
)


def raw_factors(spark, sf):
    ep = estimate.endpoints_long(rel.endpoints(spark, sf))
    cohort = staged(spark, "cohort", sf, lambda: estimate.cohort_template(rel.gated(spark, sf)))
    patient = ep.where(F.col("state_id") < R1).select(*RK, F.col("state_id").alias("factor_id"), F.col("x").alias("loading"))
    source = cohort.where((F.col("entry_type") == "A") & (F.col("col_id") < R2)).select(
        "relation_id", F.col("row_id").alias("axis_id"), F.col("col_id").alias("factor_id"), F.col("value").alias("loading")
    )
    blank = (F.col("row_id") == 2) & (F.col("relation_id") == LEFT)
    target = cohort.where((F.col("entry_type") != "e") & (F.col("row_id") < R3)).select(
        "relation_id", F.col("col_id").alias("axis_id"), F.col("row_id").alias("factor_id"), F.when(blank, 0.0).otherwise(F.col("value")).alias("loading")
    )
    cells = F.explode(
        F.array(*[F.struct(F.lit(a).alias("patient_factor_id"), F.lit(b).alias("source_factor_id"), F.lit(c).alias("target_open_factor_id"), F.lit(1.0 + a + 2 * b * c).alias("weight"))
                  for a in range(R1) for b in range(R2) for c in range(R3)])
    )
    core = cohort.select("relation_id").distinct().select("relation_id", cells.alias("c")).select("relation_id", "c.*")
    return patient, source, target, core


def normalized(spark, sf):
    patient, source, target, core = raw_factors(spark, sf)
    sums = [programs.factor_sums(f) for f in (patient, source, target)]
    factors = [programs.normalized_factor(f, s) for f, s in zip((patient, source, target), sums)]
    return (*factors, staged(spark, "core", sf, lambda: programs.normalized_core(core, *sums)))


for _n in ("pf", "sfac", "tfac"):
    view(f"{_n}_sum", f"SELECT relation_id, factor_id, sum(loading) AS scale FROM {_n} GROUP BY 1, 2", _n)
    view(f"{_n}_norm", f"SELECT {_n}.* REPLACE (CASE WHEN scale > 0 THEN loading / scale ELSE loading END AS loading) FROM {_n} JOIN {_n}_sum USING (relation_id, factor_id)", _n, f"{_n}_sum")
view(
    "core_norm",
    """SELECT c.relation_id, patient_factor_id, source_factor_id, target_open_factor_id, weight * p.scale * s.scale * t.scale AS weight FROM core c JOIN pf_sum p ON p.relation_id = c.relation_id AND p.factor_id = patient_factor_id
       JOIN sfac_sum s ON s.relation_id = c.relation_id AND s.factor_id = source_factor_id JOIN tfac_sum t ON t.relation_id = c.relation_id AND t.factor_id = target_open_factor_id""",
    "core", "pf_sum", "sfac_sum", "tfac_sum",
)
view(
    "progs",
    "SELECT relation_id, patient_factor_id, source_factor_id, target_open_factor_id, weight AS core_weight, program_id, row_number() OVER (PARTITION BY relation_id ORDER BY round(weight, 12) DESC, program_id) AS program_weight_rank FROM (SELECT *, 'p' || patient_factor_id || '_s' || source_factor_id || '_t' || target_open_factor_id AS program_id FROM core_norm)",
    "core_norm",
)
view(
    "prog_entries",
    f"""SELECT p.relation_id, program_id, s.axis_id AS source_community_id, t.axis_id AS target_open_axis_id, CASE WHEN t.axis_id < {K} THEN 'target_community' ELSE 'source_open' END AS target_open_axis_type, core_weight * s.loading * t.loading AS program_component_contribution
        FROM progs p JOIN sfac_norm s ON s.relation_id = p.relation_id AND s.factor_id = source_factor_id JOIN tfac_norm t ON t.relation_id = p.relation_id AND t.factor_id = target_open_factor_id""",
    "progs", "sfac_norm", "tfac_norm",
)
view("prog_scores", "SELECT p.relation_id, f.patient_id, program_id, f.loading * core_weight AS program_component_score FROM progs p JOIN pf_norm f ON f.relation_id = p.relation_id AND f.factor_id = patient_factor_id", "progs", "pf_norm")


@query("tensor_entries", "J1", "SELECT * FROM tensor", "tensor", "value")
def _(spark, sf):
    return programs.tensor_entries(rel.gated(spark, sf))


@query(
    "tensor_problems", "J1",
    "SELECT relation_id, patient_id, count(*) AS n, 'negative' AS problem FROM tensor WHERE value > 0.99 GROUP BY 1, 2 UNION ALL SELECT relation_id, patient_id, count(*), 'repeated' FROM tensor WHERE value > 0.9 AND value <= 0.99 GROUP BY 1, 2", "tensor",
)
def _(spark, sf):
    g = rel.gated(spark, sf).where("entry_type <> 'e'")
    v = F.col("value")
    flawed = g.withColumn("value", F.when(v > 0.99, -v).otherwise(v)).unionByName(g.where((v > 0.9) & (v <= 0.99)))
    return programs.tensor_problems(flawed)


view(
    "diagnostics",
    """SELECT relation_id, CAST(1 + row_id % 2 AS INT) AS rank_patient, 2 AS rank_source, 2 AS rank_target_open, col_id AS restart_id, CASE WHEN value < 0.0001 OR row_id = 3 AND col_id < 6 AND relation_id LIKE 'pre_F%' THEN 'failed' ELSE 'ok' END AS status, value AS relative_error
       FROM cohort WHERE entry_type <> 'e' AND row_id IN (0, 3)""",
    "cohort",
)


def diagnostics(spark, sf):
    """Stand-in diagnostics rows taken from the cohort template."""
    cohort = staged(spark, "cohort", sf, lambda: estimate.cohort_template(rel.gated(spark, sf)))
    bad = (F.col("value") < 0.0001) | ((F.col("row_id") == 3) & F.col("relation_id").like("pre_F%"))
    return cohort.where((F.col("entry_type") != "e") & F.col("row_id").isin(0, 3)).select(
        "relation_id", (1 + F.col("row_id") % 2).alias("rank_patient"), F.lit(2).alias("rank_source"), F.lit(2).alias("rank_target_open"),
        F.col("col_id").alias("restart_id"), F.when(bad, "failed").otherwise("ok").alias("status"), F.col("value").alias("relative_error"),
    )


@query(
    "best_restarts", "J3",
    "SELECT relation_id, rank_patient, rank_source, rank_target_open, restart_id, relative_error FROM (SELECT *, row_number() OVER (PARTITION BY relation_id, rank_patient, rank_source, rank_target_open ORDER BY relative_error, restart_id) AS rn FROM diagnostics WHERE status = 'ok') WHERE rn = 1",
    "diagnostics", "relative_error",
)
def _(spark, sf):
    return programs.best_restarts(diagnostics(spark, sf))


@query("failed_ranks", "J3", "SELECT relation_id, rank_patient, rank_source, rank_target_open, count(*) AS n FROM diagnostics GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (status = 'ok') = 0", "diagnostics")
def _(spark, sf):
    return programs.failed_ranks(diagnostics(spark, sf))


@query("normalized_core", "J4", "SELECT * FROM core_norm", "core_norm", "weight")
def _(spark, sf):
    return normalized(spark, sf)[3]


@query("normalized_factors", "J4", "SELECT relation_id, CAST(patient_id AS VARCHAR) AS axis, factor_id, loading FROM pf_norm UNION ALL SELECT relation_id, CAST(axis_id AS VARCHAR), factor_id, loading FROM sfac_norm", "pf_norm sfac_norm", "loading")
def _(spark, sf):
    p, s, _, _ = normalized(spark, sf)
    cols = ["relation_id", "axis", "factor_id", "loading"]
    return p.withColumnRenamed("patient_id", "axis").select(*cols).unionByName(s.withColumn("axis", F.col("axis_id").cast("string")).select(*cols))


@query("program_table", "J5", "SELECT * FROM progs", "progs", "core_weight")
def _(spark, sf):
    return programs.program_table(normalized(spark, sf)[3])


@query("program_entries", "J6", "SELECT * FROM prog_entries", "prog_entries", "program_component_contribution")
def _(spark, sf):
    _, s, t, core = normalized(spark, sf)
    return programs.program_entries(programs.program_table(core), s, t, K)


def scores(spark, sf):
    p, _, _, core = normalized(spark, sf)
    return programs.program_scores(programs.program_table(core), p)


@query("program_scores", "J7", "SELECT * FROM prog_scores", "prog_scores", "program_component_score")
def _(spark, sf):
    return scores(spark, sf)


@query("target_factor_table", "J8", f"SELECT relation_id, factor_id, axis_id, loading, CASE WHEN axis_id < {K} THEN 'target_community' ELSE 'source_open' END AS target_open_axis_type FROM tfac_norm", "tfac_norm", "loading")
def _(spark, sf):
    return programs.target_factor_table(normalized(spark, sf)[2], K)


@query(
    "rank_curve", "J9",
    "SELECT relation_id, rank_patient, rank_source, rank_target_open, restart_id, rank_patient || '/' || rank_source || '/' || rank_target_open AS rank_label, relative_error, min(relative_error) OVER (PARTITION BY relation_id, rank_patient) AS selected_error FROM diagnostics WHERE status = 'ok'",
    "diagnostics", "relative_error selected_error",
)
def _(spark, sf):
    return programs.rank_curve(diagnostics(spark, sf))


@query("program_subset", "J10", f"SELECT * FROM prog_scores WHERE relation_id = '{LEFT}' AND program_id IN ('p0_s0_t0', 'p1_s1_t1')", "prog_scores", "program_component_score")
def _(spark, sf):
    return programs.subset(scores(spark, sf), relation_id=[LEFT], program_id=["p0_s0_t0", "p1_s1_t1"])


_U = "relation_id, program_id"
view("prog_rows", f"SELECT {_U}, patient_id, program_component_score AS value, comparison_id, n_groups, place, group_id FROM prog_scores JOIN grps USING (patient_id) JOIN comparisons USING (group_id)", "prog_scores", "grps", "comparisons")


def program_rows(spark, sf):
    return programs.program_rows(scores(spark, sf), base.groups(spark, sf), comparisons(spark))


@query(
    "program_effects", "I16",
    f"""SELECT {_U}, comparison_id, (count(*) FILTER (a.value > b.value) - count(*) FILTER (a.value < b.value)) / count(*) AS effect_size FROM (SELECT * REPLACE (round(value, 12) AS value) FROM prog_rows WHERE n_groups = 2 AND place = 0) a
        JOIN (SELECT * REPLACE (round(value, 12) AS value) FROM prog_rows WHERE n_groups = 2 AND place = 1) b USING ({_U}, comparison_id) GROUP BY ALL""",
    "prog_rows", "effect_size",
)
def _(spark, sf):
    return stats.rank_sums(program_rows(spark, sf), stats.PROGRAM_UNIT).select(*stats.PROGRAM_UNIT, "comparison_id", "effect_size")


@query("program_group_association", "I16")
def _(spark, sf):
    out = stats.group_association(program_rows(spark, sf), stats.PROGRAM_UNIT)
    return out.select(*[F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in out.dtypes])


@query(
    "scores_with_stats", "A17",
    f"""SELECT s.relation_id, s.program_id, s.patient_id, s.program_component_score, m.mean_score FROM prog_scores s LEFT JOIN
        (SELECT {_U}, avg(program_component_score) AS mean_score FROM prog_scores WHERE relation_id <> '{LEFT}' GROUP BY 1, 2) m USING (relation_id, program_id)""",
    "prog_scores", "program_component_score mean_score",
)
def _(spark, sf):
    s = scores(spark, sf)
    means = s.where(F.col("relation_id") != LEFT).groupBy("relation_id", "program_id").agg(F.avg("program_component_score").alias("mean_score"))
    return sinks.scores_with_stats(s, means).select("relation_id", "program_id", "patient_id", "program_component_score", "mean_score")


@query("repeated_scores", "B11", "SELECT relation_id, patient_id, program_id, count(*) AS n_rows FROM (SELECT * FROM prog_scores UNION ALL SELECT * FROM prog_scores WHERE program_id = 'p1_s0_t1') GROUP BY 1, 2, 3 HAVING count(*) > 1", "prog_scores")
def _(spark, sf):
    s = scores(spark, sf)
    return quality.repeated_keys(s.unionByName(s.where("program_id = 'p1_s0_t1'")), ["relation_id", "patient_id", "program_id"])


@query(
    "small_program_groups", "B12",
    "SELECT relation_id, program_id, group_id, count(DISTINCT patient_id) AS n_patients FROM prog_scores JOIN grps USING (patient_id) WHERE program_component_score > 0.2 GROUP BY 1, 2, 3 HAVING count(DISTINCT patient_id) < 3", "prog_scores grps",
)
def _(spark, sf):
    big = scores(spark, sf).where("program_component_score > 0.2").join(base.groups(spark, sf), "patient_id")
    return quality.small_groups(big, ["relation_id", "program_id"])


@query(
    "program_grid_problems", "B16",
    "SELECT relation_id, program_id, source_community_id, target_open_axis_id, 'missing' AS problem FROM prog_entries WHERE source_community_id = 2 AND target_open_axis_id = 3", "prog_entries",
)
def _(spark, sf):
    _, s, t, core = normalized(spark, sf)
    entries = programs.program_entries(programs.program_table(core), s, t, K)
    return quality.program_grid_problems(entries.where("NOT (source_community_id = 2 AND target_open_axis_id = 3)"), K)


@query("tensor_decomposition", "J2")
def _(spark, sf):
    fitted = programs.decompose(rel.gated(spark, sf), [(1, 1, 1), (2, 2, 2), (2, 3, 3)], 10, K)
    return programs.rank_diagnostics(spark, fitted)


@query(
    "tensor_checks", "J2",
    """SELECT relation_id, r.a AS rank_patient, r.a2 AS rank_source, r.b AS rank_target_open, CAST(n.range AS INT) AS restart_id, 'ok' AS status, true AS relative_below_one
       FROM (SELECT DISTINCT relation_id FROM support WHERE status = 'eligible') CROSS JOIN (VALUES (1, 1, 1), (2, 2, 2)) r(a, a2, b) CROSS JOIN range(10) n""",
    "support",
)
def _(spark, sf):
    """Every rank and restart of every relation is reported, and none is worse than fitting nothing."""
    fitted = programs.decompose(rel.gated(spark, sf), [(1, 1, 1), (2, 2, 2)], 10, K)
    d = programs.rank_diagnostics(spark, fitted)
    return d.select("relation_id", "rank_patient", "rank_source", "rank_target_open", "restart_id", "status", (F.col("relative_error") < 1).alias("relative_below_one"))


@query("fitted_program_scores", "J2 J3 J4 J7")
def _(spark, sf):
    fitted = programs.decompose(rel.gated(spark, sf), [(2, 2, 3)], 10, K)
    best = programs.best_restarts(programs.rank_diagnostics(spark, fitted)).collect()
    chosen = [(r["relation_id"], r["rank_patient"], r["rank_source"], r["rank_target_open"], r["restart_id"]) for r in best]
    patient, source, target, core = programs.factor_tables(spark, fitted, chosen)
    sums = [programs.factor_sums(f) for f in (patient, source, target)]
    table = programs.program_table(programs.normalized_core(core, *sums))
    return programs.program_scores(table, programs.normalized_factor(patient, sums[0]))
