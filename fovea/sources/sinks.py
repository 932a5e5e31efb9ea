"""Keyed exports, report tables and signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.runtime import literal_table
from fovea.sources.load import ContractError


def key_problems(df: DataFrame, key: list[str]) -> DataFrame:
    """Null keys and repeated keys, one row per offending key."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("problem", F.when(missing, "null_key").when(F.col("n_rows") > 1, "duplicate_key"))
        .where(F.col("problem").isNotNull())
    )


def _require_key(df: DataFrame, key: list[str]) -> None:
    absent = [c for c in key if c not in df.columns]
    if absent:
        raise ContractError(f"key columns missing: {absent}")
    if not key_problems(df, key).isEmpty():
        raise ContractError(f"key {key} has null or repeated values")


def write_keyed_csv(df: DataFrame, path: str, key: list[str]) -> None:
    _require_key(df, key)
    df.write.mode("errorifexists").csv(path, header=True)


def write_report_bundle(metrics: DataFrame, events: DataFrame, meta: dict[str, str], path: str) -> None:
    """Metrics as CSV, events as parquet, one-row JSON metadata."""
    write_keyed_csv(metrics, f"{path}/metrics", ["patient_group_id"])
    events.write.mode("errorifexists").parquet(f"{path}/events")
    spark = metrics.sparkSession
    literal_table(spark, sorted(meta), [tuple(meta[k] for k in sorted(meta))]).write.json(f"{path}/meta")


def export_relations(entries: DataFrame, path: str, partition: str = "relation_id") -> None:
    """Long relation table, one folder per partition value; never overwrites."""
    entries.write.mode("errorifexists").partitionBy(partition).parquet(path)


def relation_record_counts(entries: DataFrame, by: list[str]) -> DataFrame:
    """Patients and values per export unit, for the counts table next to the export."""
    per_patient = entries.groupBy(*by, "patient_id").agg(F.count(F.lit(1)).alias("n_values"))
    return per_patient.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("n_values").alias("n_values"), F.lit("ok").alias("status")
    )


# Columns of the fraction comparison report.
FRACTION_COLUMNS = [
    "scale", "relation_id", "group", "patient_id", "side", "community_id",
    "community_label", "fraction", "p_value", "q_value", "test_name", "correction_method",
]


def fraction_report(df: DataFrame) -> DataFrame:
    return df.select(*FRACTION_COLUMNS)


def scores_with_stats(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Program scores with their statistics; null where no test was made."""
    return scores.join(stats, ["relation_id", "program_id"], "left")


# Hex digits of the key hash that name a bucket, level by level.
SIGNATURE_LEVELS = [8, 4, 2, 0]


def content_signature(df: DataFrame, key: list[str], payload: list[Column]) -> DataFrame:
    """SHA-256 over all rows in key-hash order, built bottom-up from short lists.

    Rows are bucketed by the first eight hex digits of their key hash, the
    bucket digests by their first four, then two, then all together: no list
    is longer than 65536 items, however large the table. Keys must be unique.
    """
    rows = df.select(
        F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256).alias("key_hash"),
        F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key], *payload), 256).alias("row_hash"),
    )

    def combine(frame: DataFrame, digits: int) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("key_hash", "row_hash")))
        joined = F.array_join(F.transform(listed, lambda s: s["row_hash"]), "")
        return frame.groupBy(F.substring("key_hash", 1, digits).alias("bucket")).agg(
            F.sha2(joined, 256).alias("row_hash"), F.sum("n").alias("n")
        ).select(F.col("bucket").alias("key_hash"), "row_hash", "n")

    level = rows.withColumn("n", F.lit(1).cast("long"))
    for digits in SIGNATURE_LEVELS:
        level = combine(level, digits)
    return level.select(F.col("n").alias("n_rows"), F.col("row_hash").alias("digest"))


def vector_json(df: DataFrame, key: list[str], index: str, value: str, alias: str) -> DataFrame:
    """One JSON list per key from long rows; the axis is state-sized."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))))
    return df.groupBy(*key).agg(F.to_json(F.transform(ordered, lambda s: s["v"])).alias(alias))


def from_vector_json(df: DataFrame, column: str, index: str, value: str) -> DataFrame:
    parsed = F.from_json(F.col(column), "array<double>")
    return df.select("*", F.posexplode(parsed).alias(index, value)).drop(column)
