"""Inputs shared by the catalog, in Spark and as reference SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.operators import compose
from fovea.plans.catalog import view
from fovea.runtime import literal_table, staged
from fovea.sources import binding, load

K = 5
DOMAINS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SUBTYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PAIRS = [("BUILDING", "MACHINERY"), ("AUTOMOBILE", "AUTOMOBILE"), ("FURNITURE", "HOUSEHOLD")]
LEFT, RIGHT = "pre_BUILDING_to_post_MACHINERY", "pre_AUTOMOBILE_to_post_AUTOMOBILE"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return binding.cells(spark, sf)


def fov_table(spark: SparkSession, sf: str) -> DataFrame:
    """Cells per state of every FOV, counted in one scan of the cells and staged for all that follows."""
    return staged(spark, "fov_counts", sf, lambda: compose.fov_counts(cells(spark, sf), K))


def composition(spark: SparkSession, sf: str) -> DataFrame:
    return compose.composition_of(fov_table(spark, sf))


def fov_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return compose.vectors_of(fov_table(spark, sf))


def fovs(spark: SparkSession, sf: str) -> DataFrame:
    return load.fovs_of(fov_table(spark, sf))


def relations(spark: SparkSession) -> DataFrame:
    return load.declare_relations(spark, PAIRS, "pre", "post")


def sides(spark: SparkSession) -> DataFrame:
    return load.relation_sides(relations(spark))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    nation = binding.table(spark, sf, "nation")
    region = binding.table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("patient_id"), F.col("r_name").alias("group_id")
    )


def labels(spark: SparkSession, name: str, values: list) -> DataFrame:
    return literal_table(spark, [name], [(v,) for v in values])


def sql_list(values: list) -> str:
    return ", ".join(f"('{v}')" if isinstance(v, str) else f"({v})" for v in values)


view(
    "cells",
    """SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
              CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS cell_id,
       CAST(c_nationkey AS VARCHAR) AS patient_id,
       CASE WHEN o_orderdate < TIMESTAMP '1998-04-01' THEN 'pre' ELSE 'post' END AS timepoint,
       CAST(c_custkey AS VARCHAR) AS fov_id, c_mktsegment AS domain_label, p_type AS cell_subtype_label,
       l_quantity AS x, l_extendedprice AS y, CAST(floor((l_quantity - 1) / 10) AS INT) AS state_id, r_name AS group_id
     FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
view("states", f"SELECT CAST(range AS INT) AS state_id FROM range({K})")
view("fovs", "SELECT patient_id, timepoint, fov_id, min(domain_label) AS domain_label, count(*) AS n_cells FROM cells GROUP BY patient_id, timepoint, fov_id", "cells")
view(
    "comp",
    """SELECT f.patient_id, f.timepoint, f.fov_id, f.domain_label, s.state_id, coalesce(c.n, 0) AS n_cells, coalesce(c.n, 0) / f.n_cells AS fraction
       FROM fovs f CROSS JOIN states s LEFT JOIN (SELECT patient_id, timepoint, fov_id, state_id, count(*) AS n FROM cells GROUP BY 1, 2, 3, 4) c
         ON c.patient_id = f.patient_id AND c.timepoint = f.timepoint AND c.fov_id = f.fov_id AND c.state_id = s.state_id""",
    "cells", "fovs", "states",
)
view(
    "relations",
    "SELECT i AS relation_index, 'pre_' || a || '_to_post_' || b AS relation_id, 'pre' AS source_timepoint, 'post' AS target_timepoint, a AS source_domain, b AS target_domain"
    " FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(PAIRS)) + ") t(i, a, b)",
)
view(
    "sides",
    """SELECT relation_id, 'source' AS side, source_timepoint AS timepoint, source_domain AS domain_label FROM relations
       UNION ALL SELECT relation_id, 'target', target_timepoint, target_domain FROM relations""",
    "relations",
)
view("domains", f"SELECT * FROM (VALUES {sql_list(DOMAINS)}) t(domain_label)")
view("subtypes", f"SELECT * FROM (VALUES {sql_list(SUBTYPES)}) t(cell_subtype_label)")
view("grps", "SELECT CAST(n_nationkey AS VARCHAR) AS patient_id, r_name AS group_id FROM nation JOIN region ON n_regionkey = r_regionkey")
view(
    "side_means",
    "SELECT s.relation_id, c.patient_id, s.side, c.state_id, avg(c.fraction) AS fraction FROM comp c JOIN sides s USING (timepoint, domain_label) GROUP BY 1, 2, 3, 4",
    "comp", "sides",
)
view(
    "endpoints",
    """SELECT a.relation_id, a.patient_id, a.state_id, a.fraction AS x, b.fraction AS y FROM side_means a JOIN side_means b
       USING (relation_id, patient_id, state_id) WHERE a.side = 'source' AND b.side = 'target'""",
    "side_means",
)
