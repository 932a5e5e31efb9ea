"""Compositions, prevalence and descriptive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions.ranks import exact_quantile
from fovea.runtime import literal_table
from fovea.schema import FOV_KEYS, WIDE_STATE_LIMIT


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _state_counts(df: DataFrame, keys: list[str], n_states: int, weight: Column | None = None) -> DataFrame:
    """One row per key with ``n``, the dense array of state counts.

    The number of states only decides the layout of the same sums: few states take one
    counter each, so a map task ships one row per key; many states take (key, state) sums
    first, then a state-sized map per key. Both keep every key and fail on a state that is
    null or outside 0..n_states-1.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    zero = F.lit(0).cast("long") if weight is None else F.lit(0.0)
    inside = F.coalesce(F.col("state_id").between(0, n_states - 1), F.lit(False))

    def checked(values: Column) -> Column:
        refusal = F.raise_error(F.lit(f"state ids must be between 0 and {n_states - 1}"))
        return F.when(F.col("n_outside") > 0, refusal).otherwise(values).alias("n")

    if n_states <= WIDE_STATE_LIMIT:
        counters = [F.coalesce(F.sum(F.when(F.col("state_id") == k, w)), zero) for k in range(n_states)]
        counted = df.groupBy(*keys).agg(F.array(*counters).alias("n"), F.count_if(~inside).alias("n_outside"))
        return counted.select(*keys, checked(F.col("n")))
    per_state = df.groupBy(*keys, F.when(inside, F.col("state_id").cast("int")).alias("state_id")).agg(F.sum(w).alias("w"))
    entry = F.when(F.col("state_id").isNotNull(), F.struct("state_id", "w"))
    maps = per_state.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("m"), F.count_if(F.col("state_id").isNull()).alias("n_outside")
    )
    axis = F.sequence(F.lit(0), F.lit(n_states - 1))
    return maps.select(*keys, checked(F.transform(axis, lambda k: F.coalesce(F.try_element_at("m", k), zero))))


def _total(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda acc, v: acc + v)


def state_fractions(df: DataFrame, keys: list[str], n_states: int) -> DataFrame:
    """Dense counts and fractions of cells per state for any key."""
    counted = _state_counts(df, keys, n_states).withColumn("total", _total(F.col("n"), F.lit(0).cast("long")))
    return counted.select(*keys, "total", F.posexplode("n").alias("state_id", "n_cells")).select(
        *keys, "state_id", "n_cells", share(F.col("n_cells"), F.col("total")).alias("fraction")
    )


def fov_counts(cells: DataFrame, n_states: int) -> DataFrame:
    """One row per FOV: its key and domain, the array ``n`` of cells per state, and their ``total``.

    Small next to the cells and enough for compositions, vectors, bags, families and support.
    """
    counted = _state_counts(cells, [*FOV_KEYS, "domain_label"], n_states)
    return counted.withColumn("total", _total(F.col("n"), F.lit(0).cast("long")))


def composition_of(counts: DataFrame) -> DataFrame:
    """Fraction of cells in each state per FOV, dense over the states, from :func:`fov_counts`."""
    keys = [*FOV_KEYS, "domain_label"]
    return counts.select(*keys, "total", F.posexplode("n").alias("state_id", "n_cells")).select(
        *keys, "state_id", "n_cells", share(F.col("n_cells"), F.col("total")).alias("fraction")
    )


def vectors_of(counts: DataFrame) -> DataFrame:
    """The same composition as one array per FOV, for row-wise kernels."""
    return counts.select(*FOV_KEYS, "domain_label", F.transform("n", lambda v: share(v, F.col("total"))).alias("fractions"))


def fov_composition(cells: DataFrame, n_states: int) -> DataFrame:
    return composition_of(fov_counts(cells, n_states))


def fov_vectors(cells: DataFrame, n_states: int) -> DataFrame:
    return vectors_of(fov_counts(cells, n_states))


def weighted_burden(df: DataFrame, keys: list[str], n_states: int, weight: str | None = None) -> DataFrame:
    """State burden and composition per observation; zero total gives zeros."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    counted = _state_counts(df, keys, n_states, w).withColumn("total", _total(F.col("n"), F.lit(0.0)))
    return counted.select(*keys, "total", F.posexplode("n").alias("state_id", "burden")).select(
        *keys, "state_id", "burden", "total", share(F.col("burden"), F.col("total")).alias("fraction")
    )


def domain_bag(composition: DataFrame, domain: str) -> DataFrame:
    return composition.where(F.col("domain_label") == domain)


def stack_bags(bags: dict[str, DataFrame]) -> DataFrame:
    parts = [df.withColumn("bag", F.lit(name)) for name, df in bags.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def family_patients(cells: DataFrame, source: str, target: str) -> DataFrame:
    """Patients seen in both domains of an ordered pair."""
    pairs = cells.where(F.col("domain_label").isin(source, target)).groupBy("patient_id").agg(
        F.max((F.col("domain_label") == source).cast("int")).alias("has_source"),
        F.max((F.col("domain_label") == target).cast("int")).alias("has_target"),
    )
    return pairs.where("has_source = 1 AND has_target = 1").select("patient_id")


def family_composition(cells: DataFrame, source: str, target: str, n_states: int, complete: bool = True) -> DataFrame:
    """FOV compositions of two domains only, with the domain as ordered side."""
    chosen = cells.where(F.col("domain_label").isin(source, target))
    if complete:
        chosen = chosen.join(family_patients(cells, source, target), "patient_id", "left_semi")
    return state_fractions(chosen, [*FOV_KEYS, "domain_label"], n_states)


def family_coverage(cells: DataFrame, source: str, target: str) -> DataFrame:
    """Eligible and skipped patients and FOV counts of an ordered pair."""
    fovs = cells.where(F.col("domain_label").isin(source, target)).groupBy(*FOV_KEYS, "domain_label").agg(
        F.count(F.lit(1)).alias("_")
    )
    per_patient = fovs.groupBy("patient_id").agg(
        F.count_if(F.col("domain_label") == source).alias("s"), F.count_if(F.col("domain_label") == target).alias("t")
    )
    ok = (F.col("s") > 0) & (F.col("t") > 0)
    return per_patient.agg(
        F.count_if(ok).alias("n_eligible_patients"),
        F.count_if(~ok).alias("n_skipped_patients"),
        F.sum(F.when(ok, F.col("s")).otherwise(0)).alias("n_source_fovs"),
        F.sum(F.when(ok, F.col("t")).otherwise(0)).alias("n_target_fovs"),
    )


def patient_domain_counts(fovs: DataFrame, domains: list[str]) -> DataFrame:
    """FOVs per patient and given domain, one column per domain."""
    return fovs.groupBy("patient_id").agg(
        *[F.count_if(F.col("domain_label") == d).alias(f"n_{d}") for d in domains], F.count(F.lit(1)).alias("n_fovs")
    )


def side_means(composition: DataFrame, sides: DataFrame) -> DataFrame:
    """Mean of the FOV vectors per relation, patient and side."""
    return (
        composition.join(sides, ["timepoint", "domain_label"])
        .groupBy("relation_id", "patient_id", "side", "state_id")
        .agg(F.avg("fraction").alias("fraction"))
    )


def side_cell_fractions(cells: DataFrame, sides: DataFrame, n_states: int) -> DataFrame:
    """Cells pooled per relation side, not FOV means."""
    return state_fractions(cells.join(sides, ["timepoint", "domain_label"]), ["relation_id", "patient_id", "side"], n_states)


def with_groups(df: DataFrame, groups: DataFrame, default: str | None = None) -> DataFrame:
    out = df.join(groups.select("patient_id", "group_id"), "patient_id", "left")
    return out if default is None else out.withColumn("group_id", F.coalesce("group_id", F.lit(default)))


def category_mix(cells: DataFrame, category: str, categories: list[str], n_states: int) -> DataFrame:
    """Fractions of given categories inside each state; an empty state is all zero."""
    counts = cells.groupBy("state_id", category).agg(F.count(F.lit(1)).alias("n_cells"))
    grid = _state_grid(cells, n_states, category, categories)
    joined = grid.join(counts, ["state_id", category], "left").select(
        "state_id", category, F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells")
    )
    whole = F.sum("n_cells").over(Window.partitionBy("state_id"))
    return joined.withColumn("fraction", share(F.col("n_cells"), whole))


def _state_grid(df: DataFrame, n_states: int, name: str, values: list[str]) -> DataFrame:
    """Fixed grid of states times given labels, as a local relation."""
    rows = [(k, v) for k in range(n_states) for v in values]
    return literal_table(df.sparkSession, ["state_id", name], rows)


def dominant_category(cells: DataFrame, category: str, n_states: int) -> DataFrame:
    """Most frequent category per state, ties to the first name; null when the state is empty."""
    counts = cells.groupBy("state_id", category).agg(F.count(F.lit(1)).alias("n_cells"))
    best = counts.groupBy("state_id").agg(
        F.min(F.struct((-F.col("n_cells")).alias("rank"), F.col(category).alias("name"))).alias("best")
    )
    axis = literal_table(cells.sparkSession, ["state_id"], [(k,) for k in range(n_states)])
    return axis.join(best, "state_id", "left").select("state_id", F.col("best.name").alias(f"dominant_{category}"))


def prevalence(cells: DataFrame, identity: list[str], n_states: int, alias: str) -> DataFrame:
    """Share of identities (patients, FOVs) that contain each state."""
    present = cells.groupBy(*identity).agg(
        F.array(*[F.max((F.col("state_id") == k).cast("int")) for k in range(n_states)]).alias("seen")
    )
    totals = present.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.array(*[F.sum(F.get("seen", F.lit(k))) for k in range(n_states)]).alias("n_with"),
    )
    return totals.select("n_all", F.posexplode("n_with").alias("state_id", "n")).select(
        "state_id", share(F.coalesce("n", F.lit(0)), F.col("n_all")).alias(alias)
    )


def community_annotation(cells: DataFrame, subtypes: list[str], n_states: int) -> DataFrame:
    """Type mix, dominant domain and time, and both prevalences, per state and type."""
    mix = category_mix(cells, "cell_subtype_label", subtypes, n_states)
    return (
        mix.join(F.broadcast(dominant_category(cells, "domain_label", n_states)), "state_id")
        .join(F.broadcast(dominant_category(cells, "timepoint", n_states)), "state_id")
        .join(F.broadcast(prevalence(cells, ["patient_id"], n_states, "patient_prevalence")), "state_id")
        .join(F.broadcast(prevalence(cells, FOV_KEYS, n_states, "fov_prevalence")), "state_id")
        .select(
            F.col("state_id").alias("community_id"),
            F.concat(F.lit("C"), F.col("state_id").cast("string")).alias("community_label"),
            F.col("cell_subtype_label").alias("cell_subtype"),
            F.col("fraction").alias("cell_fraction"),
            F.col("dominant_domain_label").alias("dominant_domain"),
            "dominant_timepoint",
            "patient_prevalence",
            "fov_prevalence",
        )
    )


def domain_distribution(cells: DataFrame, domains: list[str], n_states: int) -> DataFrame:
    """Dense state x domain counts with shares within state and within domain."""
    counts = cells.groupBy("state_id", "domain_label").agg(F.count(F.lit(1)).alias("n_cells"))
    dense = _state_grid(cells, n_states, "domain_label", domains).join(counts, ["state_id", "domain_label"], "left").select(
        "state_id", "domain_label", F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells")
    )
    return dense.select(
        "*",
        F.sum("n_cells").over(Window.partitionBy("state_id")).alias("community_total_cells"),
        F.sum("n_cells").over(Window.partitionBy("domain_label")).alias("domain_total_cells"),
    ).select(
        "*",
        share(F.col("n_cells"), F.col("community_total_cells")).alias("fraction_within_community"),
        share(F.col("n_cells"), F.col("domain_total_cells")).alias("fraction_within_domain"),
    )


def domain_prevalence(cells: DataFrame, domains: list[str], n_states: int) -> DataFrame:
    """Share of each domain's FOVs that contain a state; full FOV key on both sides."""
    per_fov = _state_counts(cells, [*FOV_KEYS, "domain_label"], n_states)
    per_domain = per_fov.groupBy("domain_label").agg(
        F.count(F.lit(1)).alias("total_fovs"),
        F.array(*[F.count_if(F.get("n", F.lit(k)) > 0) for k in range(n_states)]).alias("hits"),
    )
    listed = per_domain.select("domain_label", "total_fovs", F.posexplode("hits").alias("state_id", "positive_fovs"))
    return _state_grid(cells, n_states, "domain_label", domains).join(listed, ["state_id", "domain_label"], "left").select(
        "state_id",
        "domain_label",
        F.coalesce("positive_fovs", F.lit(0)).cast("long").alias("positive_fovs"),
        F.coalesce("total_fovs", F.lit(0)).cast("long").alias("total_fovs"),
        share(F.coalesce("positive_fovs", F.lit(0)), F.coalesce("total_fovs", F.lit(0))).alias("fov_prevalence"),
    )


def patient_occurrence(cells: DataFrame, n_states: int) -> DataFrame:
    """Per state: patients and FOVs containing it, and cells per positive patient."""
    per_fov = cells.groupBy("state_id", *FOV_KEYS).agg(F.count(F.lit(1)).alias("n_cells"))
    per_patient = per_fov.groupBy("state_id", "patient_id").agg(
        F.sum("n_cells").alias("n_cells"), F.count(F.lit(1)).alias("n_fovs")
    )
    summary = per_patient.groupBy("state_id").agg(
        F.count(F.lit(1)).alias("n_patients_present"),
        F.sum("n_cells").alias("total_cells"),
        F.max("n_cells").alias("max_cells_in_single_patient"),
        F.sum("n_fovs").alias("n_positive_fovs"),
    )
    medians = exact_quantile(
        per_patient, ["state_id"], "n_cells", 0.5, "median_cells_per_positive_patient", low=0.0, high=1e6
    )
    fovs = cells.groupBy(*FOV_KEYS).agg(F.count(F.lit(1)).alias("_"))
    totals = fovs.groupBy("patient_id").agg(F.count(F.lit(1)).alias("f")).agg(
        F.count(F.lit(1)).alias("n_patients_total"), F.sum("f").alias("n_total_fovs")
    )
    axis = literal_table(cells.sparkSession, ["state_id"], [(k,) for k in range(n_states)])
    whole = totals.withColumn("state_id", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    joined = axis.join(summary, "state_id", "left").join(medians, "state_id", "left").join(whole, "state_id", "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    return joined.select(
        "state_id",
        zero("n_patients_present").alias("n_patients_present"),
        zero("total_cells").alias("total_cells"),
        F.coalesce(F.col("median_cells_per_positive_patient").cast("double"), F.lit(0.0)).alias("median_cells_per_positive_patient"),
        zero("max_cells_in_single_patient").alias("max_cells_in_single_patient"),
        "n_patients_total",
        share(zero("n_patients_present"), F.col("n_patients_total")).alias("patient_prevalence"),
        zero("n_positive_fovs").alias("n_positive_fovs"),
        "n_total_fovs",
        share(zero("n_positive_fovs"), F.col("n_total_fovs")).alias("fov_prevalence"),
    )


def patient_state_matrix(cells: DataFrame, n_states: int) -> DataFrame:
    """0/1 occurrence, one row per patient and one column per state."""
    return cells.groupBy("patient_id").agg(
        *[F.max((F.col("state_id") == k).cast("int")).alias(f"state_{k}") for k in range(n_states)]
    )


def representative_fovs(cells: DataFrame, top: int) -> DataFrame:
    """The ``top`` states by cells, each with its best FOV.

    Best means highest fraction, then most cells, then patient, domain and FOV order.
    """
    per_fov = cells.groupBy(*FOV_KEYS, "domain_label", "state_id").agg(F.count(F.lit(1)).alias("n"))
    maps = per_fov.groupBy(*FOV_KEYS, "domain_label").agg(
        F.sum("n").alias("fov_total_cells"), F.collect_list(F.struct("state_id", "n")).alias("states")
    )
    listed = maps.select(*FOV_KEYS, "domain_label", "fov_total_cells", F.inline("states"))
    best = listed.groupBy("state_id").agg(
        F.sum("n").alias("community_total_cells"),
        F.min(
            F.struct(
                (-(F.col("n") / F.col("fov_total_cells"))).alias("f"),
                (-F.col("n")).alias("c"),
                "patient_id", "domain_label", "fov_id", "timepoint", "fov_total_cells",
            )
        ).alias("b"),
    )
    return best.orderBy(F.desc("community_total_cells"), "state_id").limit(top).select(
        "state_id",
        F.col("b.patient_id").alias("patient_id"),
        F.col("b.domain_label").alias("domain_label"),
        F.col("b.fov_id").alias("fov_id"),
        (-F.col("b.c")).alias("community_cells"),
        F.col("b.fov_total_cells").alias("fov_total_cells"),
        (-F.col("b.f")).alias("community_fraction_in_fov"),
        "community_total_cells",
    )


def count_matrix(cells: DataFrame, rows: list, columns: list, row: str, column: str) -> DataFrame:
    """Dense counts with given row and column order; absent rows are zero."""
    counts = cells.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(str(c)) for c in columns])
    axis = literal_table(cells.sparkSession, ["row_order", row], list(enumerate(rows)))
    return axis.join(counts, row, "left").select(
        "row_order", row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(str(c)) for c in columns]
    )


def domain_order(cells: DataFrame, configured: list[str]) -> DataFrame:
    """Configured domains first, further observed ones in name order."""
    seen = cells.groupBy("domain_label").agg(F.count(F.lit(1)).alias("n_cells"))
    declared = literal_table(cells.sparkSession, ["declared", "domain_label"], list(enumerate(configured)))
    joined = declared.join(seen, "domain_label", "full")
    place = Window.partitionBy(F.lit(0)).orderBy(F.coalesce("declared", F.lit(len(configured))), "domain_label")
    return joined.select(
        "domain_label", (F.row_number().over(place) - 1).alias("domain_index"), F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells")
    )


def unknown_states(cells: DataFrame, known: list[int]) -> DataFrame:
    return cells.groupBy("state_id").agg(F.count(F.lit(1)).alias("n_cells")).where(~F.col("state_id").isin(known))


def cell_frame(cells: DataFrame, fields: dict[str, str], patients: list[str]) -> DataFrame:
    return cells.where(F.col("patient_id").isin(patients)).select(*[F.col(s).alias(n) for n, s in fields.items()])


def fraction_ceiling(composition: DataFrame) -> DataFrame:
    """99th percentile of all fractions, kept between 0.25 and 1."""
    p99 = exact_quantile(composition, [], "fraction", 0.99, "p99", low=0.0, high=1.0)
    return p99.select(F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("p99"))).alias("vmax"))
