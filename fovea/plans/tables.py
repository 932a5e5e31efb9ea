"""Catalog: loading, exports and composition tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import compose
from fovea.plans import base
from fovea.plans.base import DOMAINS, K, SUBTYPES
from fovea.plans.catalog import query, view
from fovea.runtime import scratch_path
from fovea.schema import FOV_KEYS
from fovea.sources import binding, load, sinks

# --- loading ---------------------------------------------------------------


@query(
    "load_cells", "A1",
    """SELECT trim(l_returnflag) AS patient_id, CAST(l_linenumber AS VARCHAR) AS fov_id, l_quantity AS x, l_extendedprice AS y, l_tax AS tax, count(*) AS n
       FROM (SELECT l_returnflag, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem) GROUP BY 1, 2, 3, 4, 5""",
    doubles="x y tax",
)
def _(spark, sf):
    li = binding.table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_tax").alias("tax"))
    mapped = load.map_columns(li, {"patient_id": "l_returnflag", "fov_id": "l_linenumber", "x": "l_quantity", "y": "l_extendedprice"})
    return mapped.groupBy("patient_id", "fov_id", "x", "y", "tax").agg(F.count(F.lit(1)).alias("n"))


@query(
    "derive_fovs", "A2",
    "SELECT patient_id, timepoint, fov_id, min(domain_label) AS domain_label, count(DISTINCT domain_label) AS n_domains, count(*) AS n_cells FROM cells GROUP BY 1, 2, 3",
    "cells",
)
def _(spark, sf):
    return load.derive_fovs(base.cells(spark, sf))


def _fov_table(spark, sf):
    """FOV metadata from the customer table: every customer at both timepoints."""
    c = binding.table(spark, sf, "customer")
    return c.select(
        F.col("c_nationkey").cast("string").alias("patient_id"),
        F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("timepoint"),
        F.col("c_custkey").cast("string").alias("fov_id"),
        F.col("c_mktsegment").alias("domain_label"),
        F.col("c_acctbal").alias("area"),
    )


view(
    "fov_table",
    """SELECT CAST(c_nationkey AS VARCHAR) AS patient_id, t.timepoint, CAST(c_custkey AS VARCHAR) AS fov_id, c_mktsegment AS domain_label, c_acctbal AS area
       FROM customer CROSS JOIN (VALUES ('pre'), ('post')) t(timepoint)""",
)
_KEYS = "patient_id, timepoint, fov_id"


@query(
    "select_fovs", "A3",
    f"SELECT * FROM fov_table f WHERE EXISTS (SELECT 1 FROM cells c WHERE c.patient_id = f.patient_id AND c.timepoint = f.timepoint AND c.fov_id = f.fov_id)",
    "cells fov_table", "area",
)
def _(spark, sf):
    return load.select_fovs(base.cells(spark, sf), _fov_table(spark, sf))


@query(
    "cells_without_fov", "A3",
    f"SELECT DISTINCT {_KEYS} FROM cells c WHERE NOT EXISTS (SELECT 1 FROM fov_table f WHERE f.area > 0 AND c.patient_id = f.patient_id AND c.timepoint = f.timepoint AND c.fov_id = f.fov_id)",
    "cells fov_table",
)
def _(spark, sf):
    return load.cells_without_fov(base.cells(spark, sf), _fov_table(spark, sf).where("area > 0"))


@query("duplicate_fovs", "A3", "SELECT patient_id, domain_label, count(*) AS n_rows FROM fov_table GROUP BY 1, 2 HAVING count(*) > 1", "fov_table")
def _(spark, sf):
    # keyed by patient and domain so that repeated keys exist
    renamed = _fov_table(spark, sf).withColumn("fov_id", F.col("domain_label")).withColumn("timepoint", F.lit("any"))
    return load.duplicate_fovs(renamed).select("patient_id", F.col("fov_id").alias("domain_label"), "n_rows")


@query(
    "fov_key_mismatches", "A4",
    f"""SELECT {_KEYS}, 'cells_without_fov' AS problem FROM (SELECT DISTINCT {_KEYS} FROM cells EXCEPT SELECT {_KEYS} FROM fov_table WHERE area > 0)
        UNION ALL SELECT {_KEYS}, 'fov_without_cells' FROM (SELECT {_KEYS} FROM fov_table WHERE area > 0 EXCEPT SELECT {_KEYS} FROM cells)""",
    "cells fov_table",
)
def _(spark, sf):
    return load.fov_key_mismatches(base.cells(spark, sf), _fov_table(spark, sf).where("area > 0"))


@query("bad_areas", "A5", "SELECT * FROM fov_table WHERE NOT (area > 0)", "fov_table", "area")
def _(spark, sf):
    return load.bad_areas(_fov_table(spark, sf))


@query(
    "attach_fov_domain", "A6",
    """SELECT c.domain_label, f.domain_label AS fov_domain_label, c.domain_label IS NOT DISTINCT FROM f.domain_label AS domain_agrees, count(*) AS n_cells
       FROM cells c LEFT JOIN (SELECT * FROM fov_table WHERE area > 0) f USING (patient_id, timepoint, fov_id) GROUP BY 1, 2, 3""",
    "cells fov_table",
)
def _(spark, sf):
    joined = load.attach_fov_domain(base.cells(spark, sf), _fov_table(spark, sf).where("area > 0"))
    return joined.groupBy("domain_label", "fov_domain_label", "domain_agrees").agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    "declared_relations", "A7",
    """SELECT r.*, count(DISTINCT CASE WHEN s.side = 'source' THEN f.fov_id END) AS n_source_fovs FROM relations r
       JOIN sides s USING (relation_id) JOIN (SELECT DISTINCT fov_id, timepoint, domain_label FROM cells) f
       ON f.timepoint = s.timepoint AND f.domain_label = s.domain_label GROUP BY ALL""",
    "relations sides cells",
)
def _(spark, sf):
    rel, sides = base.relations(spark), base.sides(spark).where("side = 'source'")
    n = base.fovs(spark, sf).join(sides, ["timepoint", "domain_label"]).groupBy("relation_id").agg(F.count(F.lit(1)).alias("n_source_fovs"))
    return rel.join(n, "relation_id").select(*rel.columns, "n_source_fovs")


@query("unify_alias", "A8", "SELECT p_type AS cell_subtype_label, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    part = binding.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("cell_type"), F.col("p_type").alias("subtype"))
    out = load.unify_alias(part, "cell_subtype_label", ["cell_subtype_label", "subtype", "cell_type"])
    return out.groupBy("cell_subtype_label").agg(F.count(F.lit(1)).alias("n"))


@query("alias_conflicts", "A8", "SELECT p_partkey, p_type AS subtype, p_brand AS cell_type FROM part WHERE p_type IS DISTINCT FROM p_brand")
def _(spark, sf):
    part = binding.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("subtype"), F.col("p_brand").alias("cell_type"))
    return load.alias_conflicts(part, "cell_subtype_label", ["subtype", "cell_type"])


@query(
    "ingest_cells_csv", "A9",
    "SELECT patient_id, count(*) AS n_cells, count(DISTINCT cell_id) AS n_keys, sum(x) AS sum_x FROM cells GROUP BY 1",
    "cells", "sum_x",
)
def _(spark, sf):
    path = scratch_path(spark, "cells-csv")
    base.cells(spark, sf).select(F.col("cell_id").alias("CellID"), F.col("patient_id").alias("PID"), "x", "y").write.csv(path, header=True)
    read = load.read_cells_csv(spark, path, "CellID string, PID string, x double, y double")
    keyed = load.with_cell_key(read, "CellID")
    return keyed.groupBy(F.col("PID").alias("patient_id")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("cell_id").alias("n_keys"), F.sum("x").alias("sum_x")
    )


@query(
    "content_keys", "A9",
    """SELECT sha256(concat_ws('|', length(k) || ':' || k, length(l) || ':' || l)) || CASE WHEN r > 1 THEN '#' || r ELSE '' END AS cell_id, 1 AS n FROM
       (SELECT CAST(l_orderkey AS VARCHAR) AS k, CAST(l_linenumber AS VARCHAR) AS l, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS r FROM lineitem)""",
)
def _(spark, sf):
    li = binding.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return load.with_cell_key(li, "l_orderkey").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_positions", "A10",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS x,
       CASE WHEN l_returnflag <> 'R' THEN CAST(l_linenumber AS DOUBLE) END AS y, l_returnflag <> 'R' AS position_ok FROM lineitem""",
    doubles="x y",
)
def _(spark, sf):
    li = binding.table(spark, sf, "lineitem")
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), F.col("l_quantity").cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("( "), F.col("l_quantity").cast("string"), F.lit(" , "), F.col("l_linenumber").cast("string"), F.lit(")"))
    )
    return load.parse_positions(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("position")), "position").drop("position")


@query(
    "map_study_columns", "A11",
    "SELECT cell_id, patient_id, fov_id, domain_label, cell_subtype_label, x, y, '0' AS timepoint FROM cells", "cells", "x y",
)
def _(spark, sf):
    study = base.cells(spark, sf).select(
        F.col("cell_id").alias("CellID"), F.col("patient_id").alias("PID"), F.col("fov_id").alias("ID"),
        F.col("domain_label").alias("Tissue"), F.col("cell_subtype_label").alias("SubType"), "x", "y",
    )
    return load.map_study_columns(study, {
        "cell_id": "CellID", "patient_id": "PID", "fov_id": "ID", "domain_label": "Tissue", "cell_subtype_label": "SubType", "x": "x", "y": "y",
    })


# --- exports ---------------------------------------------------------------


@query("key_problems", "A12", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows, 'duplicate_key' AS problem FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return sinks.key_problems(binding.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("keyed_csv", "A12", "SELECT patient_id, timepoint, fov_id, domain_label, n_cells FROM fovs", "fovs")
def _(spark, sf):
    path = scratch_path(spark, "fovs-csv")
    sinks.write_keyed_csv(base.fovs(spark, sf).drop("n_domains"), path, FOV_KEYS)
    return spark.read.csv(path, header=True, schema="patient_id string, timepoint string, fov_id string, domain_label string, n_cells long")


@query(
    "report_bundle", "A13",
    "SELECT patient_id, event_type, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS patient_id, event_type FROM events) GROUP BY 1, 2",
)
def _(spark, sf):
    ev = binding.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("patient_id"), "event_type")
    metrics = ev.groupBy(F.col("patient_id").alias("patient_group_id")).agg(F.count(F.lit(1)).alias("n_events"))
    path = scratch_path(spark, "bundle")
    sinks.write_report_bundle(metrics, ev, {"schema_version": "1", "source": "events"}, path)
    return spark.read.parquet(f"{path}/events").groupBy("patient_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


view(
    "fov_digests",
    """SELECT sha256(concat_ws('|', patient_id, timepoint, fov_id)) AS key_hash,
       sha256(concat_ws('|', patient_id, timepoint, fov_id, domain_label, string_agg(CAST(n_cells AS VARCHAR), ',' ORDER BY state_id))) AS row_hash, 1 AS n
       FROM comp GROUP BY patient_id, timepoint, fov_id, domain_label""",
    "comp",
)
_LEVELS = {8: "fov_digests", 4: "sig8", 2: "sig4"}
for _digits, _source in _LEVELS.items():
    view(
        f"sig{_digits}",
        f"SELECT substr(key_hash, 1, {_digits}) AS key_hash, sha256(string_agg(row_hash, '' ORDER BY key_hash)) AS row_hash, sum(n) AS n FROM {_source} GROUP BY substr(key_hash, 1, {_digits})",
        _source,
    )


@query("content_signature", "A18", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(row_hash, '' ORDER BY key_hash)) AS digest FROM sig2", "sig2")
def _(spark, sf):
    comp = base.composition(spark, sf)
    listed = F.array_sort(F.collect_list(F.struct("state_id", "n_cells")))
    rows = comp.groupBy(*FOV_KEYS, "domain_label").agg(
        F.array_join(F.transform(listed, lambda s: s["n_cells"].cast("string")), ",").alias("counts")
    )
    return sinks.content_signature(rows, FOV_KEYS, [F.col("domain_label"), F.col("counts")])


@query("vector_json_round_trip", "A19", "SELECT patient_id, timepoint, fov_id, state_id, fraction FROM comp", "comp", "fraction")
def _(spark, sf):
    packed = sinks.vector_json(base.composition(spark, sf), FOV_KEYS, "state_id", "fraction", "fraction_json")
    return sinks.from_vector_json(packed, "fraction_json", "state_id", "fraction")


# --- compositions ----------------------------------------------------------

_COMP = "SELECT patient_id, timepoint, fov_id, domain_label, state_id, n_cells, fraction FROM comp"


@query("fov_composition", "E1", _COMP, "comp", "fraction")
def _(spark, sf):
    return compose.fov_composition(base.cells(spark, sf), K)


@query(
    "fov_burden", "E2",
    """SELECT patient_id, timepoint, fov_id, s.state_id, coalesce(b, 0.0) AS burden, total, CASE WHEN total > 0 THEN coalesce(b, 0.0) / total ELSE 0 END AS fraction
       FROM (SELECT patient_id, timepoint, fov_id, sum(y) AS total FROM cells GROUP BY 1, 2, 3) f CROSS JOIN states s
       LEFT JOIN (SELECT patient_id, timepoint, fov_id, state_id, sum(y) AS b FROM cells GROUP BY 1, 2, 3, 4) c USING (patient_id, timepoint, fov_id, state_id)""",
    "cells states", "burden total fraction",
)
def _(spark, sf):
    return compose.weighted_burden(base.cells(spark, sf), FOV_KEYS, K, "y")


@query(
    "domain_bags", "E3",
    "SELECT *, 'pre_side' AS bag FROM comp WHERE domain_label = 'BUILDING' UNION ALL SELECT *, 'post_side' FROM comp WHERE domain_label = 'MACHINERY'",
    "comp", "fraction",
)
def _(spark, sf):
    comp = base.composition(spark, sf)
    return compose.stack_bags({"pre_side": compose.domain_bag(comp, "BUILDING"), "post_side": compose.domain_bag(comp, "MACHINERY")})


view(
    "family_cells",
    """SELECT * FROM cells WHERE domain_label IN ('BUILDING', 'MACHINERY') AND patient_id IN
       (SELECT patient_id FROM cells WHERE domain_label IN ('BUILDING', 'MACHINERY') GROUP BY 1 HAVING count(DISTINCT domain_label) = 2)""",
    "cells",
)


@query(
    "family_composition", "E4",
    """SELECT f.patient_id, f.timepoint, f.domain_label, f.fov_id, s.state_id, count(c.cell_id) AS n_cells, count(c.cell_id) / any_value(f.n) AS fraction
       FROM (SELECT patient_id, timepoint, domain_label, fov_id, count(*) AS n FROM family_cells GROUP BY 1, 2, 3, 4) f CROSS JOIN states s
       LEFT JOIN family_cells c USING (patient_id, timepoint, domain_label, fov_id, state_id) GROUP BY 1, 2, 3, 4, 5""",
    "family_cells states", "fraction",
)
def _(spark, sf):
    return compose.family_composition(base.cells(spark, sf), "BUILDING", "MACHINERY", K)


@query(
    "family_coverage", "E5",
    """SELECT count(*) FILTER (s > 0 AND t > 0) AS n_eligible_patients, count(*) FILTER (NOT (s > 0 AND t > 0)) AS n_skipped_patients,
       CAST(sum(CASE WHEN s > 0 AND t > 0 THEN s ELSE 0 END) AS BIGINT) AS n_source_fovs, CAST(sum(CASE WHEN s > 0 AND t > 0 THEN t ELSE 0 END) AS BIGINT) AS n_target_fovs
       FROM (SELECT patient_id, count(DISTINCT CASE WHEN domain_label = 'BUILDING' THEN timepoint || '|' || fov_id END) AS s, count(DISTINCT CASE WHEN domain_label = 'MACHINERY' THEN timepoint || '|' || fov_id END) AS t
             FROM cells WHERE domain_label IN ('BUILDING', 'MACHINERY') GROUP BY 1)""",
    "cells",
)
def _(spark, sf):
    return compose.family_coverage(base.cells(spark, sf), "BUILDING", "MACHINERY")


@query(
    "patient_domain_counts", "E6",
    "SELECT patient_id, " + ", ".join(f"count(*) FILTER (domain_label = '{d}') AS \"n_{d}\"" for d in DOMAINS) + ", count(*) AS n_fovs FROM fovs GROUP BY 1",
    "fovs",
)
def _(spark, sf):
    return compose.patient_domain_counts(base.fovs(spark, sf), DOMAINS)


@query("patient_side_means", "E7", "SELECT * FROM side_means", "side_means", "fraction")
def _(spark, sf):
    return compose.side_means(base.composition(spark, sf), base.sides(spark))


@query(
    "side_fov_fractions_grouped", "E8 E10",
    "SELECT m.relation_id, m.patient_id, m.side, m.state_id, m.fraction, g.group_id FROM side_means m LEFT JOIN grps g USING (patient_id)", "side_means grps", "fraction",
)
def _(spark, sf):
    return compose.with_groups(compose.side_means(base.composition(spark, sf), base.sides(spark)), base.groups(spark, sf))


@query(
    "side_cell_fractions", "E9",
    """SELECT t.relation_id, t.patient_id, t.side, s.state_id, coalesce(c.n, 0) AS n_cells, coalesce(c.n, 0) / t.n AS fraction
       FROM (SELECT relation_id, patient_id, side, count(*) AS n FROM cells JOIN sides USING (timepoint, domain_label) GROUP BY 1, 2, 3) t CROSS JOIN states s
       LEFT JOIN (SELECT relation_id, patient_id, side, state_id, count(*) AS n FROM cells JOIN sides USING (timepoint, domain_label) GROUP BY 1, 2, 3, 4) c
       USING (relation_id, patient_id, side, state_id)""",
    "cells sides states", "fraction",
)
def _(spark, sf):
    return compose.side_cell_fractions(base.cells(spark, sf), base.sides(spark), K)


def _mix_sql(column: str, axis: str) -> str:
    return f"""SELECT s.state_id, a.{column}, coalesce(n, 0) AS n_cells, CASE WHEN t.total > 0 THEN coalesce(n, 0) / t.total ELSE 0 END AS fraction
        FROM states s CROSS JOIN {axis} a LEFT JOIN (SELECT state_id, {column}, count(*) AS n FROM cells GROUP BY 1, 2) c USING (state_id, {column})
        LEFT JOIN (SELECT state_id, count(*) AS total FROM cells GROUP BY 1) t USING (state_id)"""


view("type_mix", _mix_sql("cell_subtype_label", "subtypes"), "cells", "states", "subtypes")


@query("state_type_mix", "E11", "SELECT * FROM type_mix", "type_mix", "fraction")
def _(spark, sf):
    return compose.category_mix(base.cells(spark, sf), "cell_subtype_label", SUBTYPES, K)


view(
    "dom",
    "SELECT state_id, domain_label AS dominant_domain_label FROM (SELECT state_id, domain_label, row_number() OVER (PARTITION BY state_id ORDER BY count(*) DESC, domain_label) AS rn FROM cells GROUP BY 1, 2) WHERE rn = 1",
    "cells",
)
view(
    "dom_time",
    "SELECT state_id, timepoint AS dominant_timepoint FROM (SELECT state_id, timepoint, row_number() OVER (PARTITION BY state_id ORDER BY count(*) DESC, timepoint) AS rn FROM cells GROUP BY 1, 2) WHERE rn = 1",
    "cells",
)
view("prev_patient", "SELECT state_id, count(DISTINCT patient_id) / (SELECT count(DISTINCT patient_id) FROM cells) AS patient_prevalence FROM cells GROUP BY 1", "cells")
view("prev_fov", "SELECT state_id, count(DISTINCT (patient_id, timepoint, fov_id)) / (SELECT count(*) FROM fovs) AS fov_prevalence FROM cells GROUP BY 1", "cells", "fovs")


@query("dominant_domain", "E12", "SELECT state_id, dominant_domain_label FROM states LEFT JOIN dom USING (state_id)", "states dom")
def _(spark, sf):
    return compose.dominant_category(base.cells(spark, sf), "domain_label", K)


@query("state_prevalence", "E13", "SELECT * FROM states JOIN prev_patient USING (state_id) JOIN prev_fov USING (state_id)", "states prev_patient prev_fov", "patient_prevalence fov_prevalence")
def _(spark, sf):
    c = base.cells(spark, sf)
    return compose.prevalence(c, ["patient_id"], K, "patient_prevalence").join(compose.prevalence(c, FOV_KEYS, K, "fov_prevalence"), "state_id")


@query(
    "community_annotation", "E14",
    """SELECT state_id AS community_id, 'C' || state_id AS community_label, cell_subtype_label AS cell_subtype, fraction AS cell_fraction,
       dominant_domain_label AS dominant_domain, dominant_timepoint, patient_prevalence, fov_prevalence
       FROM type_mix LEFT JOIN dom USING (state_id) LEFT JOIN dom_time USING (state_id) JOIN prev_patient USING (state_id) JOIN prev_fov USING (state_id)""",
    "type_mix dom dom_time prev_patient prev_fov", "cell_fraction patient_prevalence fov_prevalence",
)
def _(spark, sf):
    return compose.community_annotation(base.cells(spark, sf), SUBTYPES, K)


@query(
    "fov_composition_grouped", "E15",
    """SELECT patient_id, timepoint, fov_id, domain_label, state_id, n_cells, fraction, coalesce(group_id, 'unassigned') AS group_id
       FROM comp LEFT JOIN (SELECT * FROM grps WHERE group_id <> 'ASIA') USING (patient_id)""",
    "comp grps", "fraction",
)
def _(spark, sf):
    return compose.with_groups(base.composition(spark, sf), base.groups(spark, sf).where("group_id <> 'ASIA'"), "unassigned")


view(
    "domain_dist",
    """SELECT state_id, domain_label, n_cells, CAST(sum(n_cells) OVER (PARTITION BY state_id) AS BIGINT) AS community_total_cells,
       CAST(sum(n_cells) OVER (PARTITION BY domain_label) AS BIGINT) AS domain_total_cells,
       n_cells / sum(n_cells) OVER (PARTITION BY state_id) AS fraction_within_community, n_cells / sum(n_cells) OVER (PARTITION BY domain_label) AS fraction_within_domain
       FROM (SELECT s.state_id, d.domain_label, count(c.cell_id) AS n_cells FROM states s CROSS JOIN domains d LEFT JOIN cells c USING (state_id, domain_label) GROUP BY 1, 2)""",
    "states", "domains", "cells",
)


@query("domain_distribution", "E16", "SELECT * FROM domain_dist", "domain_dist", "fraction_within_community fraction_within_domain")
def _(spark, sf):
    return compose.domain_distribution(base.cells(spark, sf), DOMAINS, K)


@query(
    "domain_fov_prevalence", "E17",
    """SELECT s.state_id, d.domain_label, coalesce(p.n, 0) AS positive_fovs, t.n AS total_fovs, coalesce(p.n, 0) / t.n AS fov_prevalence FROM states s CROSS JOIN domains d
       LEFT JOIN (SELECT state_id, domain_label, count(DISTINCT (patient_id, timepoint, fov_id)) AS n FROM cells GROUP BY 1, 2) p USING (state_id, domain_label)
       LEFT JOIN (SELECT domain_label, count(*) AS n FROM fovs GROUP BY 1) t USING (domain_label)""",
    "states domains cells fovs", "fov_prevalence",
)
def _(spark, sf):
    return compose.domain_prevalence(base.cells(spark, sf), DOMAINS, K)


view(
    "occurrence",
    """SELECT state_id, count(*) AS n_patients_present, CAST(sum(n) AS BIGINT) AS total_cells, median(n) AS median_cells_per_positive_patient, max(n) AS max_cells_in_single_patient,
       (SELECT count(DISTINCT patient_id) FROM cells) AS n_patients_total, count(*) / (SELECT count(DISTINCT patient_id) FROM cells) AS patient_prevalence,
       CAST(sum(f) AS BIGINT) AS n_positive_fovs, (SELECT count(*) FROM fovs) AS n_total_fovs, sum(f) / (SELECT count(*) FROM fovs) AS fov_prevalence
       FROM (SELECT state_id, patient_id, count(*) AS n, count(DISTINCT (timepoint, fov_id)) AS f FROM cells GROUP BY 1, 2) GROUP BY 1""",
    "cells", "fovs",
)


@query("patient_occurrence", "E18", "SELECT * FROM occurrence", "occurrence", "median_cells_per_positive_patient patient_prevalence fov_prevalence")
def _(spark, sf):
    return compose.patient_occurrence(base.cells(spark, sf), K)


@query(
    "patient_state_matrix", "E19",
    "SELECT patient_id, " + ", ".join(f"CAST(max(CASE WHEN state_id = {k} THEN 1 ELSE 0 END) AS INT) AS state_{k}" for k in range(K)) + " FROM cells GROUP BY 1", "cells",
)
def _(spark, sf):
    return compose.patient_state_matrix(base.cells(spark, sf), K)


@query(
    "representative_fovs", "E20",
    """SELECT state_id, patient_id, domain_label, fov_id, n AS community_cells, t AS fov_total_cells, n / t AS community_fraction_in_fov, tot AS community_total_cells FROM (
         SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY n / t DESC, n DESC, patient_id, domain_label, fov_id, timepoint) AS rn FROM
           (SELECT state_id, patient_id, timepoint, domain_label, fov_id, count(*) AS n FROM cells GROUP BY 1, 2, 3, 4, 5) a
           JOIN (SELECT patient_id, timepoint, domain_label, fov_id, count(*) AS t FROM cells GROUP BY 1, 2, 3, 4) b USING (patient_id, timepoint, domain_label, fov_id)
           JOIN (SELECT state_id, count(*) AS tot FROM cells GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) USING (state_id)) WHERE rn = 1""",
    "cells", "community_fraction_in_fov",
)
def _(spark, sf):
    return compose.representative_fovs(base.cells(spark, sf), 3)


@query(
    "count_matrix", "E21",
    "SELECT r.i AS row_order, r.cell_subtype_label, " + ", ".join(f"count(*) FILTER (c.domain_label = '{d}') AS \"{d}\"" for d in DOMAINS)
    + " FROM (VALUES (0, 'SMALL'), (1, 'LARGE'), (2, 'ABSENT'), (3, 'PROMO'), (4, 'ECONOMY'), (5, 'MEDIUM'), (6, 'STANDARD')) r(i, cell_subtype_label) LEFT JOIN cells c USING (cell_subtype_label) GROUP BY 1, 2",
    "cells",
)
def _(spark, sf):
    return compose.count_matrix(base.cells(spark, sf), ["SMALL", "LARGE", "ABSENT", "PROMO", "ECONOMY", "MEDIUM", "STANDARD"], DOMAINS, "cell_subtype_label", "domain_label")


@query(
    "domain_order", "E22",
    """SELECT domain_label, CAST(row_number() OVER (ORDER BY coalesce(p, 2), domain_label) - 1 AS INT) AS domain_index, coalesce(n, 0) AS n_cells
       FROM (VALUES (0, 'MACHINERY'), (1, 'BUILDING')) d(p, domain_label) FULL JOIN (SELECT domain_label, count(*) AS n FROM cells GROUP BY 1) USING (domain_label)""",
    "cells",
)
def _(spark, sf):
    return compose.domain_order(base.cells(spark, sf), ["MACHINERY", "BUILDING"])


@query("unknown_states", "E22", "SELECT state_id, count(*) AS n_cells FROM cells WHERE state_id NOT IN (0, 1, 2) GROUP BY 1", "cells")
def _(spark, sf):
    return compose.unknown_states(base.cells(spark, sf), [0, 1, 2])


@query(
    "cell_frame", "E23",
    "SELECT patient_id, fov_id, domain_label, state_id AS community_id, cell_subtype_label AS cell_subtype FROM cells", "cells",
)
def _(spark, sf):
    fields = {"patient_id": "patient_id", "fov_id": "fov_id", "domain_label": "domain_label", "community_id": "state_id", "cell_subtype": "cell_subtype_label"}
    return compose.cell_frame(base.cells(spark, sf), fields, [str(i) for i in range(25)])


@query("fov_composition_sorted", "E24", _COMP + " ORDER BY domain_label, patient_id, timepoint, fov_id, state_id", "comp", "fraction")
def _(spark, sf):
    return base.composition(spark, sf).orderBy("domain_label", "patient_id", "timepoint", "fov_id", "state_id")


@query("fraction_ceiling", "E25", "SELECT greatest(0.25, least(1.0, quantile_cont(fraction, 0.99))) AS vmax FROM comp", "comp", "vmax")
def _(spark, sf):
    return compose.fraction_ceiling(base.composition(spark, sf))
