"""Ranks, medians and positions that never need a whole group in one task.

A plain window sorts each group in one task. A group may hold a third of all
rows, so these helpers first collapse ties (map-side), cut each group into
buckets, add up the few bucket counts per group, and rank inside the buckets.
The bucket only spreads the work: the ranks are exact whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.runtime import durable, shuffle_width

BUCKETS = 1024


def _offsets(df: DataFrame, scope: list[str], bucket: str, sizes: dict[str, tuple[str, str]]) -> DataFrame:
    """Totals before each bucket and in the whole scope; bounded by the bucket count.

    ``sizes`` maps an input column to the names (before, whole) of its two totals.
    """
    per_bucket = df.groupBy(*scope, bucket).agg(*[F.sum(c).alias(c) for c in sizes])
    before = Window.partitionBy(*scope).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*scope)
    totals = []
    for column, (left, full) in sizes.items():
        totals.append(F.coalesce(F.sum(column).over(before), F.lit(0)).alias(left))
        totals.append(F.sum(column).over(whole).alias(full))
    return per_bucket.select(*scope, bucket, *totals)


def value_ranks(
    df: DataFrame,
    scope: list[str],
    value: str,
    *,
    low: float = -1.0,
    high: float = 1.0,
    counts: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per distinct value of each scope: ties, rows below, n, average rank,
    and the sums of the values below and of all values.

    ``low`` and ``high`` are the usual range of the values; values outside fall
    into the end buckets and are still ranked exactly. ``counts`` adds further
    aggregates per distinct value, e.g. the ties of one group.
    """
    extra = [c.alias(name) for name, c in (counts or {}).items()]
    collapsed = (
        df.where(F.col(value).isNotNull())
        .groupBy(*scope, value)
        .agg(F.count(F.lit(1)).alias("ties"), *extra)
        .withColumn("_mass", F.col("ties") * F.col(value))
        .withColumn(
            "_bucket",
            F.floor(
                (F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high)) - F.lit(low))
                / F.lit(high - low) * F.lit(BUCKETS)
            ),
        )
    )
    offsets = _offsets(collapsed, scope, "_bucket", {"ties": ("_before", "n"), "_mass": ("_mass_before", "sum_all")})
    inner = Window.partitionBy(*scope, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        collapsed.join(offsets, [*scope, "_bucket"])
        .withColumn("below", F.col("_before") + F.coalesce(F.sum("ties").over(inner), F.lit(0)))
        .withColumn("sum_below", F.col("_mass_before") + F.coalesce(F.sum("_mass").over(inner), F.lit(0)))
        .withColumn("avg_rank", F.col("below") + (F.col("ties") + 1) / 2)
    )
    return ranked.select(*scope, value, "ties", *(counts or {}).keys(), "below", "n", "avg_rank", "sum_below", "sum_all")


def at_quantile(value: str, prob: float) -> Column:
    """Aggregate over ``value_ranks`` rows: the linearly interpolated quantile."""
    position = F.lit(prob) * (F.col("n") - 1)
    low, high = F.floor(position), F.ceil(position)

    def pick(index: Column) -> Column:
        inside = (F.col("below") <= index) & (index < F.col("below") + F.col("ties"))
        return F.max(F.when(inside, F.col(value)))

    lower, upper = pick(low), pick(high)
    return lower + (upper - lower) * F.max(position - low)


def exact_quantile(
    df: DataFrame, scope: list[str], value: str, prob: float, alias: str,
    *, low: float = -1.0, high: float = 1.0,
) -> DataFrame:
    ranked = value_ranks(df, scope, value, low=low, high=high)
    return ranked.groupBy(*scope).agg(at_quantile(value, prob).alias(alias))


def exact_median(df: DataFrame, scope: list[str], value: str, alias: str, **span) -> DataFrame:
    return exact_quantile(df, scope, value, 0.5, alias, **span)


def hash_positions(df: DataFrame, scope: list[str], digest: str, alias: str, total: str) -> DataFrame:
    """1-based position of each row by an evenly spread hex digest within the scope."""
    spread = df.withColumn("_bucket", F.substring(F.col(digest), 1, 2)).withColumn("_one", F.lit(1))
    offsets = _offsets(spread, scope, "_bucket", {"_one": ("_before", "n")})
    inner = Window.partitionBy(*scope, "_bucket").orderBy(digest)
    return (
        spread.join(offsets, [*scope, "_bucket"])
        .withColumn(alias, F.col("_before") + F.row_number().over(inner))
        .withColumnRenamed("n", total)
        .drop("_bucket", "_one", "_before")
    )


def ordered_positions(
    df: DataFrame, scope: list[str], order: list[str], alias: str, total: str, width: int | None = None
) -> DataFrame:
    """1-based position of each row by arbitrary sort keys within the scope.

    The rows are range-partitioned once over all scopes together and that
    layout is made durable, so a large scope spans many tasks and the chunk
    numbers stay the same when a task is repeated.
    """
    n = width or shuffle_width(df.sparkSession)
    chunked = durable(
        df.repartitionByRange(n, *scope, *order).withColumn("_bucket", F.spark_partition_id())
    ).withColumn("_one", F.lit(1))
    offsets = _offsets(chunked, scope, "_bucket", {"_one": ("_before", "n")})
    inner = Window.partitionBy(*scope, "_bucket").orderBy(*order)
    return (
        chunked.join(offsets, [*scope, "_bucket"])
        .withColumn(alias, F.col("_before") + F.row_number().over(inner))
        .withColumnRenamed("n", total)
        .drop("_bucket", "_one", "_before")
    )
