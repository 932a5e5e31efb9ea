"""View of the order tables as a spatial cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.runtime import source_tasks, widen

SPLIT_DATE = "1998-04-01"


# Declared schemas, so that opening a table starts no inference job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell.

    Join sides are left to the optimizer: small dimensions broadcast because
    their file sizes are known, large ones fall back to a shuffle join. Lines and
    orders beyond what the cores take at once are dealt by the size of the files:
    keys shrink so well in a shuffle that merging its partitions by bytes would put
    millions of cells into one sort.
    """
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = source_tasks(spark, f"{sf_dir}/lineitem.parquet")
    if tasks > spark.sparkContext.defaultParallelism:
        li, orders = li.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    else:
        li = widen(li, "l_orderkey", "l_partkey")
    joined = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        F.concat_ws(
            "-",
            F.col("l_orderkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.col("l_quantity").cast("int").cast("string"),
            F.col("l_shipdate").cast("date").cast("string"),
        ).alias("cell_id"),
        F.col("c_nationkey").cast("string").alias("patient_id"),
        F.when(F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), "pre")
        .otherwise("post")
        .alias("timepoint"),
        F.col("c_custkey").cast("string").alias("fov_id"),
        F.col("c_mktsegment").alias("domain_label"),
        F.col("p_type").alias("cell_subtype_label"),
        F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("int").alias("state_id"),
        F.col("r_name").alias("group_id"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("cell_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("label"),
    )
