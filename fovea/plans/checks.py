"""Catalog: data-quality checks, run on the bound tables with known flaws added."""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import quality
from fovea.plans import base
from fovea.plans.base import K
from fovea.plans.catalog import query, view
from fovea.schema import FOV_KEYS
from fovea.sources import binding

_KEYS = "patient_id, timepoint, fov_id"

# Flawed inputs: the same expressions on both sides.
view(
    "flawed",
    """SELECT cell_id, CASE WHEN x = 7 THEN NULL ELSE patient_id END AS patient_id, CASE WHEN x = 8 THEN '  ' ELSE timepoint END AS timepoint, fov_id,
       CASE WHEN x = 9 THEN 'OTHER' ELSE domain_label END AS domain_label, CASE WHEN x = 10 THEN CAST('inf' AS DOUBLE) WHEN x = 11 THEN NULL ELSE x END AS x, y,
       CASE WHEN x = 12 THEN 1.5 WHEN x = 13 THEN 9 WHEN x = 14 THEN -1 ELSE state_id END AS state_value FROM cells""",
    "cells",
)


def _flawed(spark, sf):
    x = F.col("x")
    c = base.cells(spark, sf)
    return c.select(
        "cell_id",
        F.when(x == 7, None).otherwise(F.col("patient_id")).alias("patient_id"),
        F.when(x == 8, "  ").otherwise(F.col("timepoint")).alias("timepoint"),
        "fov_id",
        F.when(x == 9, "OTHER").otherwise(F.col("domain_label")).alias("domain_label"),
        F.when(x == 10, float("inf")).when(x == 11, None).otherwise(x).alias("x"),
        "y",
        F.when(x == 12, 1.5).when(x == 13, 9.0).when(x == 14, -1.0).otherwise(F.col("state_id").cast("double")).alias("state_value"),
    )


@query(
    "blank_identifiers", "B1",
    """SELECT 'patient_id' AS column_name, count(*) FILTER (patient_id IS NULL) AS n_null, count(*) FILTER (trim(patient_id) = '') AS n_blank FROM flawed
       UNION ALL SELECT 'timepoint', count(*) FILTER (timepoint IS NULL), count(*) FILTER (trim(timepoint) = '') FROM flawed
       UNION ALL SELECT 'fov_id', count(*) FILTER (fov_id IS NULL), count(*) FILTER (trim(fov_id) = '') FROM flawed""",
    "flawed",
)
def _(spark, sf):
    return quality.blank_identifiers(_flawed(spark, sf), ["patient_id", "timepoint", "fov_id"])


@query("bad_coordinates", "B2", "SELECT cell_id, y FROM flawed WHERE x IS NULL OR isinf(x) OR isnan(x)", "flawed", "y")
def _(spark, sf):
    return quality.bad_coordinates(_flawed(spark, sf)).select("cell_id", "y")


@query(
    "repeated_cell_ids", "B3",
    "SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS cell_id, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, sf):
    li = binding.table(spark, sf, "lineitem")
    keyed = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cell_id"))
    return quality.repeated_keys(keyed, ["cell_id"])


@query(
    "mixed_domain_fovs", "B4",
    f"SELECT {_KEYS}, count(DISTINCT domain_label) AS n_domains FROM flawed GROUP BY 1, 2, 3 HAVING count(DISTINCT domain_label) > 1", "flawed",
)
def _(spark, sf):
    return quality.mixed_domain_fovs(_flawed(spark, sf))


@query("bad_state_ids", "B5", "SELECT cell_id, state_value FROM flawed WHERE state_value <> floor(state_value) OR state_value NOT BETWEEN 0 AND 4", "flawed", "state_value")
def _(spark, sf):
    return quality.bad_state_ids(_flawed(spark, sf), K, "state_value").select("cell_id", "state_value")


view("stored_comp", "SELECT * EXCLUDE (fraction), CASE WHEN n_cells = 5 THEN fraction * 0.5 ELSE fraction END AS fraction FROM comp WHERE NOT (state_id = 4 AND n_cells = 6)", "comp")


def _stored(spark, sf):
    comp = base.composition(spark, sf)
    return comp.where(~((F.col("state_id") == 4) & (F.col("n_cells") == 6))).withColumn(
        "fraction", F.when(F.col("n_cells") == 5, F.col("fraction") * 0.5).otherwise(F.col("fraction"))
    )


@query(
    "bad_compositions", "B6",
    f"""SELECT {_KEYS}, count(*) FILTER (fraction < 0) AS n_bad, count(*) AS n_states, sum(fraction) AS total FROM stored_comp GROUP BY 1, 2, 3
        HAVING count(*) FILTER (fraction < 0) > 0 OR count(*) <> 5 OR abs(sum(fraction) - 1) > 1e-8""",
    "stored_comp", "total",
)
def _(spark, sf):
    return quality.bad_compositions(_stored(spark, sf), K)


@query(
    "unsupported_relations", "B8",
    """SELECT s.* FROM sides s WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.timepoint = s.timepoint AND c.domain_label = s.domain_label AND c.domain_label NOT IN ('MACHINERY', 'FURNITURE'))""",
    "sides cells",
)
def _(spark, sf):
    seen = base.fovs(spark, sf).where(~F.col("domain_label").isin("MACHINERY", "FURNITURE"))
    return quality.unsupported_relations(base.sides(spark), seen).select("relation_id", "side", "timepoint", "domain_label")


view(
    "flawed_cost",
    """SELECT a.state_id AS i, b.state_id AS j, CASE WHEN a.state_id = 1 AND b.state_id = 3 THEN -1.0 WHEN a.state_id = 2 AND b.state_id = 2 THEN 0.5 ELSE abs(a.m - b.m) END AS cost
       FROM (SELECT state_id, avg(y) AS m FROM cells GROUP BY 1) a JOIN (SELECT state_id, avg(y) AS m FROM cells GROUP BY 1) b ON NOT (a.state_id = 4 AND b.state_id = 0)""",
    "cells",
)


def mean_cost(spark, sf):
    """|difference of mean y| between states, as (i, j, cost)."""
    m = base.cells(spark, sf).groupBy("state_id").agg(F.avg("y").alias("m")).where(F.col("state_id").between(0, K - 1))
    listed = m.groupBy().agg(F.array_sort(F.collect_list(F.struct("state_id", "m"))).alias("all"))
    pair = listed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    return pair.select(F.col("a.state_id").alias("i"), F.col("b.state_id").alias("j"), F.abs(F.col("a.m") - F.col("b.m")).alias("cost"))


@query(
    "bad_state_costs", "B9",
    """SELECT 'negative_or_missing' AS problem, CAST(2 AS BIGINT) AS n WHERE (SELECT count(*) FROM flawed_cost) = 24 AND (SELECT count(*) FROM flawed_cost WHERE cost < 0) = 1
       UNION ALL SELECT 'diagonal', count(*) FROM flawed_cost WHERE i = j AND abs(cost) > 1e-12
       UNION ALL SELECT 'asymmetric', count(*) FROM flawed_cost a FULL JOIN (SELECT j AS i, i AS j, cost AS back FROM flawed_cost) b USING (i, j) WHERE coalesce(abs(cost - back), 1) > 1e-12
       UNION ALL SELECT 'incomplete', 25 - count(cost) FROM flawed_cost""",
    "flawed_cost",
)
def _(spark, sf):
    i, j = F.col("i"), F.col("j")
    cost = mean_cost(spark, sf).where(~((i == 4) & (j == 0))).withColumn(
        "cost", F.when((i == 1) & (j == 3), -1.0).when((i == 2) & (j == 2), 0.5).otherwise(F.col("cost"))
    )
    return quality.bad_state_costs(cost, K)


@query(
    "stale_compositions", "B10",
    f"""SELECT {_KEYS}, state_id, s.fraction AS stored_fraction, c.fraction AS fresh_fraction FROM comp c FULL JOIN stored_comp s USING ({_KEYS}, state_id)
        WHERE coalesce(abs(s.fraction - c.fraction) > 1e-8, true)""",
    "comp stored_comp", "stored_fraction fresh_fraction",
)
def _(spark, sf):
    return quality.stale_compositions(_stored(spark, sf), base.composition(spark, sf))


view("side_patients", "SELECT DISTINCT s.relation_id, s.side, c.patient_id, c.group_id FROM cells c JOIN sides s USING (timepoint, domain_label) WHERE c.x > 49", "cells", "sides")


@query(
    "small_groups", "B12",
    "SELECT relation_id, group_id, count(DISTINCT patient_id) AS n_patients FROM side_patients WHERE patient_id NOT IN (SELECT patient_id FROM cells WHERE x = 1 AND domain_label = 'BUILDING' AND timepoint = 'post') GROUP BY 1, 2 HAVING count(DISTINCT patient_id) < 3",
    "cells side_patients",
)
def _(spark, sf):
    c = base.cells(spark, sf)
    gone = c.where("x = 1 AND domain_label = 'BUILDING' AND timepoint = 'post'").select("patient_id").distinct()
    seen = c.where("x > 49").join(base.sides(spark), ["timepoint", "domain_label"]).join(gone, "patient_id", "left_anti")
    return quality.small_groups(seen, ["relation_id"])


@query("varying_timepoints", "B13", "SELECT count(DISTINCT timepoint) AS n_timepoints, count(*) AS n_cells FROM cells HAVING count(DISTINCT timepoint) > 1", "cells")
def _(spark, sf):
    return quality.varying_timepoints(base.cells(spark, sf))


# Fixed statuses so that every kind of problem occurs on real rows.
view(
    "flawed_metrics",
    """SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 'again' ELSE CAST(c_custkey AS VARCHAR) END AS patient_group_id,
       CASE WHEN c_acctbal < 0 THEN 'ERR_UOT_EMPTY_SUPPORT' WHEN c_acctbal > 9000 THEN 'lost' ELSE 'ok' END AS uot_status,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS "T" FROM customer""",
)


@query(
    "bad_metrics", "B14",
    """SELECT * FROM (SELECT patient_group_id, CASE WHEN patient_group_id IS NULL THEN 'missing_key' WHEN uot_status = 'lost' THEN 'unknown_status'
         WHEN uot_status <> 'ok' AND "T" IS NOT NULL THEN 'value_without_fit' END AS problem FROM flawed_metrics) WHERE problem IS NOT NULL
       UNION ALL SELECT patient_group_id, 'duplicate_key' FROM flawed_metrics GROUP BY 1 HAVING count(*) > 1""",
    "flawed_metrics",
)
def _(spark, sf):
    c = binding.table(spark, sf, "customer")
    metrics = c.select(
        F.when(F.col("c_custkey") % 97 == 0, None).when(F.col("c_custkey") % 89 == 0, "again").otherwise(F.col("c_custkey").cast("string")).alias("patient_group_id"),
        F.when(F.col("c_acctbal") < 0, "ERR_UOT_EMPTY_SUPPORT").when(F.col("c_acctbal") > 9000, "lost").otherwise("ok").alias("uot_status"),
        F.when(F.col("c_mktsegment") == "BUILDING", None).otherwise(F.col("c_acctbal")).alias("T"),
    )
    return quality.bad_metrics(metrics)


@query("missing_groups", "B15", "SELECT DISTINCT patient_id FROM cells WHERE patient_id NOT IN (SELECT patient_id FROM grps WHERE group_id <> 'ASIA')", "cells grps")
def _(spark, sf):
    return quality.missing_groups(base.cells(spark, sf), base.groups(spark, sf).where("group_id <> 'ASIA'"))


@query("undersized_fovs", "B17", f"SELECT {_KEYS}, count(*) AS n_cells FROM cells GROUP BY 1, 2, 3 HAVING count(*) < 6", "cells")
def _(spark, sf):
    return quality.undersized_fovs(base.cells(spark, sf), 5)


@query("unknown_patients", "B18", "SELECT patient_id FROM (SELECT DISTINCT CAST(s_nationkey + 3 AS VARCHAR) AS patient_id FROM supplier) WHERE patient_id NOT IN (SELECT patient_id FROM cells)", "cells")
def _(spark, sf):
    asked = binding.table(spark, sf, "supplier").select((F.col("s_nationkey") + 3).cast("string").alias("patient_id")).distinct()
    return quality.unknown_patients(asked, base.cells(spark, sf))


@query(
    "dataset_report", "B23",
    f"""SELECT count(*) AS n_cells, count(DISTINCT patient_id) AS n_patients, count(DISTINCT ({_KEYS})) AS n_fovs, count(DISTINCT domain_label) AS n_domains,
        count(DISTINCT state_id) AS n_states, count(DISTINCT state_id) = 5 AS all_states_present FROM cells""",
    "cells",
)
def _(spark, sf):
    return quality.dataset_report(base.cells(spark, sf), K)
