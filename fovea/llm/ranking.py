"""Gapless positions inside groups without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.runtime import write_stage

#: Rows that one sort of the numbering holds; the table is cut into as many ranges as it needs.
RANGE_ROWS = 50_000


def positions(rows: DataFrame, group: str, order: list[str], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``out``: 0..n-1 inside each value of ``group``, in the order of ``order``.

    The whole table is cut into ranges of (group, order), so a group of any size is many
    ranges; rows are numbered inside their range and moved up by what the earlier ranges of
    the group hold. ``rows`` must be staged, it is read three times. Rows equal in ``order``
    take neighbouring places, one each.
    """
    ranges = max(1, -(-rows.count() // range_rows))
    ranges = max(ranges, rows.sparkSession.sparkContext.defaultParallelism)
    cut = write_stage(rows.repartitionByRange(ranges, group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = cut.groupBy(group, "__range").count().select(
        F.col(group).alias("__g"),
        F.col("__range").alias("__r"),
        (F.sum("count").over(Window.partitionBy(group).orderBy("__range")) - F.col("count")).alias("__before"),
    )
    inside = cut.withColumn("__row", F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)))
    return (
        inside.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
        .withColumn(out, (F.col("__before") + F.col("__row") - 1).cast("long"))
        .drop("__g", "__r", "__range", "__before", "__row")
    )
