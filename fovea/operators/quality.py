"""Data-quality checks. Each returns the violations; ``require_clean`` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.schema import FOV_KEYS, REL_PATIENT, SIMPLEX_TOL, SYMMETRY_TOL
from fovea.sources.load import ContractError


def require_clean(violations: DataFrame, what: str) -> None:
    """Strict mode: one small job, stops at the first violation."""
    found = violations.limit(3).collect()
    if found:
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _not_finite(column: str) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def blank_identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and blank counts per identifier column, in one pass."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in columns] + [
        F.count_if(F.trim(F.col(c)) == "").alias(f"{c}_blank") for c in columns
    ]
    totals = df.agg(*counts)
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(f"{c}_null").alias("n_null"),
                        F.col(f"{c}_blank").alias("n_blank"),
                    )
                    for c in columns
                ]
            )
        )
    )


def bad_coordinates(cells: DataFrame) -> DataFrame:
    return cells.where(_not_finite("x") | _not_finite("y"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def mixed_domain_fovs(cells: DataFrame) -> DataFrame:
    """FOVs whose cells name more than one domain."""
    pairs = cells.groupBy(*FOV_KEYS, "domain_label").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*FOV_KEYS).agg(F.count(F.lit(1)).alias("n_domains")).where("n_domains > 1")


def bad_state_ids(cells: DataFrame, n_states: int, column: str = "state_id") -> DataFrame:
    s = F.col(column).cast("double")
    bad = s.isNull() | F.isnan(s) | (s != F.floor(s)) | (s < 0) | (s >= n_states)
    return cells.where(bad)


def bad_compositions(composition: DataFrame, n_states: int, tol: float = SIMPLEX_TOL) -> DataFrame:
    """FOVs whose fractions are negative, not finite, incomplete or do not sum to one."""
    return (
        composition.groupBy(*FOV_KEYS)
        .agg(
            F.count_if(_not_finite("fraction") | (F.col("fraction") < 0)).alias("n_bad"),
            F.count(F.lit(1)).alias("n_states"),
            F.sum("fraction").alias("total"),
        )
        .where((F.col("n_bad") > 0) | (F.col("n_states") != n_states) | (F.abs(F.col("total") - 1) > tol))
    )


def bad_relations(entries: DataFrame, tol: float = SIMPLEX_TOL) -> DataFrame:
    """Rows breaking A, d >= 0, 0 <= e <= 1 or ``sum_j A[i,j] + d[i] = 1``."""
    v = F.col("value")
    is_e = F.col("entry_type") == "e"
    return (
        entries.withColumn("axis", F.when(is_e, "target").otherwise("source"))
        .withColumn("axis_id", F.when(is_e, F.col("col_id")).otherwise(F.col("row_id")))
        .groupBy(*REL_PATIENT, "axis", "axis_id")
        .agg(
            F.count_if(_not_finite("value") | (v < 0) | (is_e & (v > 1))).alias("n_bad"),
            F.sum(v).alias("total"),
        )
        .where((F.col("n_bad") > 0) | ((F.col("axis") == "source") & (F.abs(F.col("total") - 1) > tol)))
    )


def unsupported_relations(sides: DataFrame, fovs: DataFrame) -> DataFrame:
    """Relation sides that select no FOV anywhere in the cohort."""
    return sides.join(
        fovs.select("timepoint", "domain_label").distinct(), ["timepoint", "domain_label"], "left_anti"
    )


def bad_state_costs(cost: DataFrame, n_states: int) -> DataFrame:
    """Problems of a cost matrix: shape, sign, diagonal, symmetry, no positive entry."""
    flipped = cost.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("cost").alias("back"))
    both = cost.join(flipped, ["i", "j"], "full")
    out_of_range = ~(F.col("i").between(0, n_states - 1) & F.col("j").between(0, n_states - 1))
    checks = both.agg(
        F.count_if(out_of_range).alias("out_of_range"),
        F.count_if(F.col("cost").isNull() | F.isnan("cost") | (F.col("cost") < 0)).alias("negative_or_missing"),
        F.count_if((F.col("i") == F.col("j")) & (F.abs("cost") > SYMMETRY_TOL)).alias("diagonal"),
        F.count_if(F.coalesce(F.abs(F.col("cost") - F.col("back")), F.lit(1.0)) > SYMMETRY_TOL).alias("asymmetric"),
        (F.lit(n_states * n_states) - F.count("cost")).alias("incomplete"),
        (F.when(F.count_if((F.col("i") != F.col("j")) & (F.col("cost") > 0)) > 0, 0).otherwise(1)).cast("long").alias("no_positive"),
    )
    names = ["out_of_range", "negative_or_missing", "diagonal", "asymmetric", "incomplete", "no_positive"]
    listed = F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).alias("n")) for n in names])
    return checks.select(F.inline(listed)).where("n <> 0")


def stale_compositions(stored: DataFrame, fresh: DataFrame, tol: float = SIMPLEX_TOL) -> DataFrame:
    """Differences between a stored FOV table and a fresh computation."""
    key = [*FOV_KEYS, "state_id"]
    a = stored.select(*key, F.col("fraction").alias("stored_fraction"))
    b = fresh.select(*key, F.col("fraction").alias("fresh_fraction"))
    gap = F.abs(F.col("stored_fraction") - F.col("fresh_fraction"))
    return a.join(b, key, "full").where(F.coalesce(gap > tol, F.lit(True)))


def small_groups(df: DataFrame, scope: list[str], minimum: int = 3) -> DataFrame:
    """Groups with too few patients, per scope (relation, program, ...)."""
    pairs = df.groupBy(*scope, "group_id", "patient_id").agg(F.count(F.lit(1)).alias("_"))
    return pairs.groupBy(*scope, "group_id").agg(F.count(F.lit(1)).alias("n_patients")).where(
        F.col("n_patients") < minimum
    )


def varying_timepoints(cells: DataFrame) -> DataFrame:
    """More than one raw timepoint where the domain is the ordered axis."""
    seen = cells.groupBy("timepoint").agg(F.count(F.lit(1)).alias("n_cells"))
    totals = seen.agg(F.count(F.lit(1)).alias("n_timepoints"), F.sum("n_cells").alias("n_cells"))
    return totals.where("n_timepoints > 1")


# Permitted statuses and nullable columns of a metrics table.
METRIC_STATUSES = [
    "ok", "ERR_UOT_EMPTY_MASS_SOURCE", "ERR_UOT_EMPTY_MASS_TARGET", "ERR_UOT_EMPTY_SUPPORT", "ERR_UOT_NUMERICAL",
]
METRIC_COLUMNS = ["T", "D_pos", "B_pos", "d_rel", "b_rel", "M", "R", "tau"]


def bad_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows with a missing or repeated key, unknown status or values despite not being ok."""
    values = [c for c in METRIC_COLUMNS if c in metrics.columns]
    filled = _any([F.col(c).isNotNull() for c in values])
    dup = repeated_keys(metrics, ["patient_group_id"]).select("patient_group_id", F.lit("duplicate_key").alias("problem"))
    rows = metrics.select(
        "patient_group_id",
        F.when(F.col("patient_group_id").isNull(), "missing_key")
        .when(~F.col("uot_status").isin(METRIC_STATUSES), "unknown_status")
        .when((F.col("uot_status") != "ok") & filled, "value_without_fit")
        .alias("problem"),
    ).where(F.col("problem").isNotNull())
    return rows.unionByName(dup)


def missing_groups(patients: DataFrame, groups: DataFrame) -> DataFrame:
    return patients.select("patient_id").distinct().join(
        groups.where(F.col("group_id").isNotNull()), "patient_id", "left_anti"
    )


def _grid_problems(df: DataFrame, scope: list[str], grid: Column, key: list[str]) -> DataFrame:
    """Missing, unexpected and repeated cells of a state-sized grid, per scope."""
    expected = df.select(*scope).distinct().select(*scope, F.inline(grid))
    have = df.groupBy(*scope, *key).agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        expected.withColumn("expected", F.lit(True))
        .join(have, [*scope, *key], "full")
        .withColumn(
            "problem",
            F.when(F.col("n_rows").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("n_rows") > 1, "repeated"),
        )
        .where(F.col("problem").isNotNull())
        .select(*scope, *key, "problem")
    )


def _square(rows: int, cols: int, cell) -> Column:
    """Array of ``cell(i, j)`` over a fixed grid; rows and columns are state-sized."""
    def line(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: cell(i, j))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), line))


def program_grid_problems(entries: DataFrame, n_states: int) -> DataFrame:
    grid = _square(n_states, n_states + 1, lambda i, j: F.struct(i.alias("source_community_id"), j.alias("target_open_axis_id")))
    return _grid_problems(entries, ["relation_id", "program_id"], grid, ["source_community_id", "target_open_axis_id"])


def augmented_grid(n_states: int) -> Column:
    """Every (entry_type, row_id, col_id) of the augmented matrix, without the corner."""
    def cell(i: Column, j: Column) -> Column:
        kind = F.when(i == n_states, "e").when(j == n_states, "d").otherwise("A")
        return F.struct(kind.alias("entry_type"), i.alias("row_id"), j.alias("col_id"))

    grid = _square(n_states + 1, n_states + 1, cell)
    return F.filter(grid, lambda c: ~((c["row_id"] == n_states) & (c["col_id"] == n_states)))


def augmented_grid_problems(entries: DataFrame, scope: list[str], n_states: int) -> DataFrame:
    return _grid_problems(entries, scope, augmented_grid(n_states), ["entry_type", "row_id", "col_id"])


def undersized_fovs(cells: DataFrame, k: int) -> DataFrame:
    return cells.groupBy(*FOV_KEYS).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") < k + 1)


def unknown_patients(requested: DataFrame, cells: DataFrame) -> DataFrame:
    return requested.join(cells.select("patient_id").distinct(), "patient_id", "left_anti")


def blocking_fits(status: DataFrame) -> DataFrame:
    """Families that may not be analysed, with how often each reason occurs."""
    reasons = status.where("fit_status <> 'ok'").groupBy("relation_id", "fit_status").agg(
        F.count(F.lit(1)).alias("n_patients")
    )
    text = F.concat(F.col("fit_status"), F.lit(":"), F.col("n_patients").cast("string"))
    return reasons.groupBy("relation_id").agg(
        F.sum("n_patients").alias("n_blocking"), F.array_join(F.array_sort(F.collect_list(text)), ",").alias("reasons")
    )


def bad_features(features: DataFrame, n_labels: int, tol: float = SIMPLEX_TOL) -> DataFrame:
    """Cells whose feature vector is incomplete, negative, not finite or off the simplex."""
    return (
        features.groupBy("cell_id")
        .agg(
            F.count_if(_not_finite("fraction") | (F.col("fraction") < 0)).alias("n_bad"),
            F.count(F.lit(1)).alias("n_labels"),
            F.sum("fraction").alias("total"),
        )
        .where((F.col("n_bad") > 0) | (F.col("n_labels") != n_labels) | (F.abs(F.col("total") - 1) > tol))
    )


def basis_problems(cells: DataFrame, centroids: DataFrame, n_states: int, width: int) -> DataFrame:
    """Stored states without a centroid, and centroids of the wrong count or width."""
    orphans = cells.groupBy("state_id").agg(F.count(F.lit(1)).alias("n")).join(
        centroids.select("state_id"), "state_id", "left_anti"
    ).select(F.lit("state_without_centroid").alias("problem"), F.col("n"))
    shape = centroids.agg(
        F.count_if(F.size("features") != width).alias("wrong_width"),
        F.abs(F.count(F.lit(1)) - n_states).alias("wrong_count"),
    )
    listed = F.array(
        F.struct(F.lit("wrong_width").alias("problem"), F.col("wrong_width").alias("n")),
        F.struct(F.lit("wrong_count").alias("problem"), F.col("wrong_count").alias("n")),
    )
    return orphans.unionByName(shape.select(F.inline(listed)).where("n > 0"))


def incomplete_calibration(real: DataFrame, null: DataFrame, n_permutations: int) -> DataFrame:
    """Patients without exactly one real record or with missing, repeated or extra permutations."""
    r = real.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_real"))
    per_index = null.groupBy("patient_id", "permutation_index").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("permutation_index").between(0, n_permutations - 1)
    n = per_index.groupBy("patient_id").agg(
        F.count_if(inside).alias("n_indices"),
        F.count_if(~inside).alias("n_outside"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
    )
    ok = (
        (F.col("n_real") == 1) & (F.col("n_indices") == n_permutations) & (F.col("n_outside") == 0) & (F.col("n_repeated") == 0)
    )
    return r.join(n, "patient_id", "full").where(~F.coalesce(ok, F.lit(False)))


def summary_problems(summary: DataFrame, status: DataFrame, names: list[str], scales: list[str]) -> DataFrame:
    """Repeated keys, unknown names, and rows that disagree with the fit status."""
    key = ["relation_id", "patient_id", "summary_name", "scale"]
    repeated = repeated_keys(summary, key).select("relation_id", "patient_id", F.lit("repeated").alias("problem"))
    unknown = summary.where(~(F.col("summary_name").isin(names) & F.col("scale").isin(scales))).select(
        "relation_id", "patient_id", F.lit("unknown_name").alias("problem")
    )
    present = summary.groupBy("relation_id", "patient_id").agg(F.count(F.lit(1)).alias("n"))
    joined = status.join(present, ["relation_id", "patient_id"], "full")
    ok = F.coalesce(F.col("fit_status") == "ok", F.lit(False))
    against = joined.select(
        "relation_id",
        "patient_id",
        F.when(ok & F.col("n").isNull(), "missing_row").when(~ok & F.col("n").isNotNull(), "row_without_fit").alias("problem"),
    ).where(F.col("problem").isNotNull())
    return repeated.unionByName(unknown).unionByName(against)


def dataset_report(cells: DataFrame, n_states: int) -> DataFrame:
    """Counts of the cohort from one pre-aggregated table, and whether all states occur."""
    base = cells.groupBy(*FOV_KEYS, "domain_label", "state_id").agg(F.count(F.lit(1)).alias("n"))
    counted = base.agg(
        F.sum("n").alias("n_cells"),
        F.count_distinct("patient_id").alias("n_patients"),
        F.count_distinct(*FOV_KEYS).alias("n_fovs"),
        F.count_distinct("domain_label").alias("n_domains"),
        F.count_distinct("state_id").alias("n_states"),
    )
    return counted.withColumn("all_states_present", F.col("n_states") == n_states)
