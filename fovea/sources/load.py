"""Loading: column mapping, FOV metadata, relation declarations, study files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.runtime import literal_table
from fovea.schema import CELL_COLUMNS, FOV_KEYS


class ContractError(ValueError):
    """An input breaks a declared contract."""


def map_columns(df: DataFrame, mapping: dict[str, str], keep_extras: bool = True) -> DataFrame:
    """Rename caller columns (``canonical -> source``) and keep the others.

    An extra column whose name equals a canonical one would be ambiguous and is rejected.
    """
    missing = sorted(set(mapping.values()) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    used = set(mapping.values())
    extras = [c for c in df.columns if c not in used] if keep_extras else []
    clash = sorted(set(extras) & (set(mapping) | set(CELL_COLUMNS)))
    if clash:
        raise ContractError(f"extra columns collide with canonical names: {clash}")
    ids = {c for c in mapping if c not in ("x", "y", "area")}
    picked = [
        (F.trim(F.col(source).cast("string")) if name in ids else F.col(source).cast("double")).alias(name)
        for name, source in mapping.items()
    ]
    return df.select(*picked, *[F.col(c) for c in extras])


def derive_fovs(cells: DataFrame) -> DataFrame:
    """FOV rows from cells; ``n_domains > 1`` marks an inconsistent FOV.

    A FOV's set of domain labels is short, so it is merged map-side in one shuffle.
    """
    return cells.groupBy(*FOV_KEYS).agg(
        F.min("domain_label").alias("domain_label"),
        F.size(F.collect_set("domain_label")).cast("long").alias("n_domains"),
        F.count(F.lit(1)).alias("n_cells"),
    )


def fovs_of(counts: DataFrame) -> DataFrame:
    """The rows of :func:`derive_fovs` from rows already counted per FOV and domain (``total``)."""
    return counts.groupBy(*FOV_KEYS).agg(
        F.min("domain_label").alias("domain_label"), F.count("domain_label").alias("n_domains"), F.sum("total").alias("n_cells")
    )


def _cell_fov_keys(cells: DataFrame) -> DataFrame:
    return cells.select(*FOV_KEYS).distinct()


def select_fovs(cells: DataFrame, fovs: DataFrame) -> DataFrame:
    """Keep the FOV rows that have cells."""
    return fovs.join(_cell_fov_keys(cells), FOV_KEYS, "left_semi")


def cells_without_fov(cells: DataFrame, fovs: DataFrame) -> DataFrame:
    return _cell_fov_keys(cells).join(fovs, FOV_KEYS, "left_anti")


def fovs_without_cells(cells: DataFrame, fovs: DataFrame) -> DataFrame:
    """FOV rows nobody uses: dropped by default, an error in the strict reading."""
    return fovs.join(_cell_fov_keys(cells), FOV_KEYS, "left_anti")


def fov_key_mismatches(cells: DataFrame, fovs: DataFrame) -> DataFrame:
    """Both directions of the strict key check."""
    return (
        cells_without_fov(cells, fovs).select(*FOV_KEYS, F.lit("cells_without_fov").alias("problem"))
        .unionByName(
            fovs_without_cells(cells, fovs).select(*FOV_KEYS, F.lit("fov_without_cells").alias("problem"))
        )
    )


def duplicate_fovs(fovs: DataFrame) -> DataFrame:
    return fovs.groupBy(*FOV_KEYS).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def bad_areas(fovs: DataFrame, area: str = "area") -> DataFrame:
    """FOVs whose area is not a finite positive number."""
    value = F.expr(f"try_cast({area} AS double)")
    ok = value.isNotNull() & ~F.isnan(value) & (value != F.lit(float("inf"))) & (value > 0)
    return fovs.where(~F.coalesce(ok, F.lit(False)))


def attach_fov_domain(cells: DataFrame, fovs: DataFrame) -> DataFrame:
    """Cells with their FOV's domain and whether the two agree."""
    meta = fovs.select(*FOV_KEYS, F.col("domain_label").alias("fov_domain_label"))
    return cells.join(meta, FOV_KEYS, "left").withColumn(
        "domain_agrees", F.col("domain_label").eqNullSafe(F.col("fov_domain_label"))
    )


def declare_relations(
    spark: SparkSession, pairs: list[tuple[str, str]], source: str, target: str
) -> DataFrame:
    """Relations dimension from (source domain, target domain) pairs."""
    if len(set(pairs)) != len(pairs):
        raise ContractError("relation domain pairs must be unique")
    rows = [
        (i, f"{source}_{a}_to_{target}_{b}", source, target, a, b) for i, (a, b) in enumerate(pairs)
    ]
    return literal_table(
        spark,
        ["relation_index", "relation_id", "source_timepoint", "target_timepoint", "source_domain", "target_domain"],
        rows,
    )


def relation_sides(relations: DataFrame) -> DataFrame:
    """Two rows per relation: which time and domain each side selects."""
    return relations.select(
        "relation_id",
        F.inline(
            F.array(
                F.struct(F.lit("source").alias("side"), F.col("source_timepoint").alias("timepoint"), F.col("source_domain").alias("domain_label")),
                F.struct(F.lit("target").alias("side"), F.col("target_timepoint").alias("timepoint"), F.col("target_domain").alias("domain_label")),
            )
        ),
    )


def _present(df: DataFrame, canonical: str, aliases: list[str]) -> list[str]:
    names = [a for a in aliases if a in df.columns]
    if canonical in names:
        names = [canonical] + [a for a in names if a != canonical]
    if not names:
        raise ContractError(f"none of {aliases} is present")
    return names


def unify_alias(df: DataFrame, canonical: str, aliases: list[str]) -> DataFrame:
    """The first present alias becomes the canonical column; the others are dropped."""
    names = _present(df, canonical, aliases)
    return df.withColumn(canonical, F.col(names[0])).drop(*[n for n in names if n != canonical])


def alias_conflicts(df: DataFrame, canonical: str, aliases: list[str]) -> DataFrame:
    """Rows where two present aliases differ."""
    names = _present(df, canonical, aliases)
    differs = [~F.col(names[0]).eqNullSafe(F.col(n)) for n in names[1:]]
    return df.where(reduce(lambda a, b: a | b, differs, F.lit(False)))


def read_cells_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


#: Rows that one task groups by their whole content.
ROWS_PER_TASK = 500_000


def with_cell_key(df: DataFrame, natural: str) -> DataFrame:
    """The natural key when every value is present and unique, else a content hash.

    Equal rows are told apart by their occurrence: the second gets ``#2`` behind the hash, and
    so on. They are interchangeable, so a row is counted and written out again as often. The
    check is one aggregate over pre-grouped keys; only three counts reach the driver. The number
    of rows decides how many tasks group them, as few bytes of sorted keys are many rows.
    """
    keyed = df.groupBy(natural).agg(F.count(F.lit(1)).alias("n"))
    row = keyed.agg(
        F.max("n").alias("top"), F.count_if(F.col(natural).isNull()).alias("nulls"), F.sum("n").alias("rows")
    ).first()
    if row["top"] == 1 and row["nulls"] == 0:
        return df.withColumn("cell_id", F.col(natural).cast("string"))
    value = lambda c: F.col(c).cast("string")
    content = F.concat_ws("|", *[F.coalesce(F.concat(F.length(value(c)), F.lit(":"), value(c)), F.lit("-")) for c in df.columns])
    dealt = df
    if row["rows"] and row["top"] <= ROWS_PER_TASK:  # equal rows share their key: no large group of copies, which would be counted before the shuffle
        tasks = max(-(-row["rows"] // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
        dealt = df.repartition(tasks, *df.columns)
    each = dealt.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).select(
        *df.columns, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__occurrence")
    )
    later = F.when(F.col("__occurrence") > 1, F.concat(F.lit("#"), F.col("__occurrence").cast("string"))).otherwise("")
    return each.withColumn("cell_id", F.concat(F.sha2(content, 256), later)).drop("__occurrence")


# Fixed value: what a position string looks like.
POSITION = r"^\(\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*\)$"


def parse_positions(df: DataFrame, column: str) -> DataFrame:
    """Add ``x``, ``y`` and ``position_ok`` from strings like ``(1.5, -2e3)``."""

    def part(index: int) -> Column:
        return F.regexp_extract(F.col(column), POSITION, index).try_cast("double")

    x, y = part(1), part(2)
    return df.select("*", x.alias("x"), y.alias("y"), F.coalesce(x.isNotNull() & y.isNotNull(), F.lit(False)).alias("position_ok"))


def map_study_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Study table to canonical cells; this study has one timepoint."""
    return df.select(
        *[F.col(source).alias(name) for name, source in names.items()],
        F.lit("0").alias("timepoint"),
    )
