"""Summaries of fitted relations: totals, family and community tables, matrix views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.operators.estimate import pack_relations, vsum
from fovea.runtime import literal_table
from fovea.schema import COORD, REL_PATIENT

# Family summaries with their role, axis and expected tail.
SUMMARIES = [
    ("self_retention", "proof_carrying", "source", "left"),
    ("depletion", "proof_carrying", "source", "right"),
    ("off_diagonal_remodeling", "diagnostic_supportive", "source", "right"),
    ("emergence", "supportive", "target", "right"),
]
SCALES = ["burden_weighted", "community_mean"]


def augmented_entries(template: DataFrame, n_states: int, keys: list[str]) -> DataFrame:
    """Augmented coordinates including the masked corner (null value)."""
    corner = template.select(*keys).distinct().select(
        *keys, F.lit("masked").alias("entry_type"), F.lit(n_states).alias("row_id"), F.lit(n_states).alias("col_id"), F.lit(None).cast("double").alias("value")
    )
    return template.select(*keys, *COORD, "value").unionByName(corner)


def grouped_entries(entries: DataFrame, groups: DataFrame | None, relation_ids: list[str] | None = None) -> DataFrame:
    """Entries with the caller's group, ``all`` without groups."""
    chosen = entries if relation_ids is None else entries.where(F.col("relation_id").isin(relation_ids))
    if groups is None:
        return chosen.withColumn("group_id", F.lit("all"))
    return chosen.join(groups.select("patient_id", "group_id"), "patient_id", "left")


def continuity(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Diagonal, off-diagonal, open and total mass with their shares (null on zero mass)."""
    v, kind = F.col("value"), F.col("entry_type")
    on = (kind == "A") & (F.col("row_id") == F.col("col_id"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    sums = entries.groupBy(*keys).agg(
        total(on).alias("diagonal_mass"),
        total(kind == "A").alias("total_continuity_mass"),
        total(kind == "d").alias("total_depletion_mass"),
        total(kind == "e").alias("total_emergence_mass"),
    )
    opened = F.col("total_depletion_mass") + F.col("total_emergence_mass")
    whole = F.col("total_continuity_mass") + opened
    return sums.select(
        *keys, "diagonal_mass",
        (F.col("total_continuity_mass") - F.col("diagonal_mass")).alias("offdiagonal_mass"),
        "total_continuity_mass", "total_depletion_mass", "total_emergence_mass",
        (F.col("total_continuity_mass") / F.when(whole > 0, whole)).alias("continuity_fraction"),
        (opened / F.when(whole > 0, whole)).alias("open_fraction"),
    )


def pathologies(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Flags for collapsed, wide open or non-finite relations."""
    v = F.col("value")
    bad = entries.groupBy(*keys).agg(
        F.max((v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("int")).alias("bad")
    )
    share = F.col("diagonal_mass") / F.when(F.col("total_continuity_mass") > 0, F.col("total_continuity_mass"))
    return continuity(entries, keys).join(bad, keys).select(
        *keys,
        F.coalesce(share > 0.99, F.lit(False)).alias("diagonal_collapse"),
        F.coalesce(F.col("open_fraction") > 0.95, F.lit(False)).alias("open_channel_overuse"),
        (F.col("bad") == 1).alias("nonfinite_payload"),
    )


def continuity_score(entries: DataFrame, keys: list[str]) -> DataFrame:
    c = continuity(entries, keys)
    t = F.col("total_continuity_mass")
    return c.select(*keys, F.when(t > 0, F.col("diagonal_mass") / t).otherwise(0.0).alias("continuity_score"))


def _diagonal(matrix: str) -> Column:
    return F.transform(matrix, lambda row, i: F.get(row, i))


def _row_sums(matrix: str) -> Column:
    return F.transform(matrix, vsum)


def packed_with_burden(entries: DataFrame, endpoints: DataFrame, keys: list[str], n_states: int) -> DataFrame:
    """One row per relation with A, d, e and the burdens x, y; everything below is row-local."""
    return pack_relations(entries, keys, n_states).join(endpoints.select(*keys, "x", "y"), keys)


def _weighted(values: Column, weights: Column) -> Column:
    total = vsum(weights)
    return vsum(F.zip_with(values, weights, lambda v, w: v * w)) / F.when(total > 0, total)


def _present_mean(values: Column, weights: Column) -> Column:
    n = F.size(F.filter(weights, lambda w: w > 0))
    return vsum(F.zip_with(values, weights, lambda v, w: F.when(w > 0, v).otherwise(0.0))) / F.when(n > 0, n)


def family_summaries(packed: DataFrame, keys: list[str]) -> DataFrame:
    """The four family summaries on both scales, in long form."""
    cols = packed.withColumn("on", _diagonal("A")).withColumn("rows", _row_sums("A")).withColumn(
        "off", F.zip_with("rows", "on", lambda r, o: r - o)
    )
    vectors = {"self_retention": "on", "depletion": "d", "off_diagonal_remodeling": "off", "emergence": "e"}
    items = []
    for name, role, axis, _ in SUMMARIES:
        weights = F.col("x" if axis == "source" else "y")
        value = F.col(vectors[name])
        for scale, fn in (("burden_weighted", _weighted), ("community_mean", _present_mean)):
            items.append(
                F.struct(
                    F.lit(name).alias("summary_name"),
                    F.lit(role).alias("summary_role"),
                    F.lit(scale).alias("scale"),
                    fn(value, weights).alias("value"),
                    F.lit(axis).alias("eligible_entity_axis"),
                    F.size(F.filter(weights, lambda w: w > 0)).alias("eligible_entity_count"),
                    vsum(weights).alias("burden_total"),
                )
            )
    return cols.select(*keys, F.inline(F.array(*items)))


def source_communities(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Per source state: weight, retention, depletion and off-diagonal, plain and times burden."""
    rows = packed.withColumn("sx", vsum(F.col("x"))).select(*keys, "x", "d", "sx", F.posexplode("A").alias("source_community_id", "row"))
    here = F.col("source_community_id")
    burden = F.get("x", here)
    live = burden > 0
    on, off = F.get("row", here), vsum(F.col("row")) - F.get("row", here)
    return rows.select(
        *keys, "source_community_id",
        burden.alias("source_burden"),
        F.when(live & (F.col("sx") > 0), burden / F.col("sx")).otherwise(0.0).alias("source_weight"),
        F.when(live, on).alias("self_retention"),
        F.when(live, F.get("d", here)).alias("depletion"),
        F.when(live, off).alias("off_diagonal_remodeling"),
        F.when(live, on * burden).alias("self_retention_burden"),
        F.when(live, F.get("d", here) * burden).alias("depletion_burden"),
        F.when(live, off * burden).alias("off_diagonal_burden"),
    )


def target_communities(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Per target state: matched incoming burden, open tendency and open burden."""
    rows = packed.withColumn("sx", vsum(F.col("x"))).withColumn("sy", vsum(F.col("y"))).select(
        *keys, "A", "x", "sx", "sy", F.posexplode(F.arrays_zip("y", "e")).alias("target_community_id", "t")
    )
    here, burden = F.col("target_community_id"), F.col("t.y")
    live = burden > 0
    incoming = vsum(F.zip_with("A", "x", lambda row, x: F.get(row, here) * x))
    return rows.select(
        *keys, "target_community_id",
        burden.alias("target_burden"),
        F.when(live & (F.col("sy") > 0), burden / F.col("sy")).otherwise(0.0).alias("target_weight"),
        F.when(live, incoming).alias("matched_incoming_burden"),
        F.when(live, F.col("t.e")).alias("open_incoming_tendency"),
        F.when(live, F.col("t.e") * F.col("sx")).alias("open_incoming_burden"),
    )


def fit_status(support: DataFrame, fitted: DataFrame) -> DataFrame:
    """Status per relation and patient: ok, deferred (one side missing) or failed."""
    done = fitted.select(*REL_PATIENT).distinct().withColumn("fitted", F.lit(True))
    return support.join(done, REL_PATIENT, "left").select(
        *REL_PATIENT,
        F.when(F.col("status") != "eligible", "deferred").when(F.col("fitted"), "ok").otherwise("failed").alias("fit_status"),
        F.when(F.col("status") != "eligible", F.col("status")).alias("defer_reason"),
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("relation_id", "fit_status").agg(F.count(F.lit(1)).alias("n_patients"))


def fit_facts(status: DataFrame) -> DataFrame:
    """Whole-fit facts with support per relation as a map."""
    per_relation = status.groupBy("relation_id").agg(
        F.count_if(F.col("fit_status") == "ok").alias("n_ok"), F.count_if(F.col("fit_status") != "ok").alias("n_warnings")
    )
    patients = status.select("patient_id").distinct().agg(F.count(F.lit(1)).alias("n_patients")).withColumn("one", F.lit(1))
    totals = per_relation.agg(
        F.count(F.lit(1)).alias("n_relations"),
        F.sum("n_warnings").alias("n_warnings"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation_id", "n_ok")))).alias("support"),
    ).withColumn("one", F.lit(1))
    return totals.join(patients, "one").drop("one")


def matrix_view(entries: DataFrame, keys: list[str], order: list[int], n_states: int) -> DataFrame:
    """Wide augmented matrix with rows and columns in a full permutation of the states."""
    if sorted(order) != list(range(n_states)):
        raise ValueError("the order must be a permutation of all states")
    rows = literal_table(entries.sparkSession, ["row_position", "row_id"], list(enumerate([*order, n_states])))
    columns = [
        F.max(F.when(F.col("col_id") == state, F.col("value"))).alias(f"c{position}")
        for position, state in enumerate([*order, n_states])
    ]
    return entries.groupBy(*keys, "row_id").agg(*columns).join(F.broadcast(rows), "row_id")
