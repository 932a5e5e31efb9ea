"""Small helpers around the Spark session."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may do without that setting; on a
    cluster each executor would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = spark.conf.get("spark.fovea.local.dir", None)
    if not local:
        local = tempfile.mkdtemp(prefix="spark-fovea-", dir="/tmp")
        spark.conf.set("spark.fovea.local.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh output path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage, survives lost executors, and unlike a checkpoint keeps column
    pruning, statistics and compression for the steps that read it.
    """
    path = scratch_path(df.sparkSession, name)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_stages() -> list[str]:
    """Folders of ``write_stage`` that were not dropped, oldest first."""
    return list(_written)


def drop_stages(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete these folders of ``write_stage``, or all; frames that still read them stop working."""
    for folder in written_stages() if folders is None else folders:
        if folder in _written:
            _written.remove(folder)
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_below(spark: SparkSession):
    """Makes checkpoints of RDDs go below the shared folder; returns what notes a written one for ``drop_stages`` and names its folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))

    def note(rdd) -> str:
        _written.append(rdd.getCheckpointFile())
        return _written[-1]

    return note


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` below the shared folder and cut its lineage."""
    return write_stage(df, "durable")


_stages: dict[tuple, DataFrame] = {}


def forget_stages() -> None:
    """Drop all stage results, e.g. after the source tables changed or to time a cold run."""
    _stages.clear()


def _state_of(spark: SparkSession, folder: str) -> str:
    """Digest of names, sizes and times of all files below a folder; changes when one of them does.

    A table may be a folder of files, whose own entry says nothing about its content.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def staged(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """Result of a pipeline stage, computed once per session and state of the source folder.

    Patient-level tables are used several times by one query and by many queries;
    without this each use would scan the cells again.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir, _state_of(spark, sf_dir))
    if key not in _stages:
        _stages[key] = durable(build())
    return _stages[key]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of Parquet files whose rows one task sorts for a join.
TASK_BYTES = 8 << 20


def source_tasks(spark: SparkSession, path: str) -> int:
    """Tasks that the files of a table are worth. Only lists them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return -(-size // TASK_BYTES)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer input splits than cores; a no-op for large inputs.

    One small file is one task, which would also run every broadcast join behind
    it. Counting the splits only plans the scan. Rows go by the hash of ``keys``:
    a round robin would first sort them to stay repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() * 2 <= cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores for compute-heavy Python steps.

    The rows are few bytes but costly, so the size-based merging of shuffle
    partitions would put them into one task; a fixed width prevents that.
    """
    width = max(shuffle_width(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(width, *keys)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(value) + "D"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed dimension as a local relation, so its size is known to the optimizer."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def state_axis(n_states: int):
    """Expression that turns one row into one row per state."""
    return F.explode(F.sequence(F.lit(0), F.lit(n_states - 1)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, mapping -0.0 to 0.0, for reports and comparisons.

    Values are moved off the half-way points first, which sums in another order would
    otherwise fall on either side of.
    """
    return df.select(
        *[
            (F.round(F.col(c) + F.lit(1e-10), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )
