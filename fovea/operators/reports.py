"""Report tables derived from the summaries, contrasts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions import pvalues
from fovea.functions.ranks import exact_median
from fovea.operators import stats
from fovea.operators.compose import share
from fovea.runtime import literal_table


def state_row_order(mix: DataFrame, occurrence: DataFrame, types: list[str]) -> DataFrame:
    """States by a summed type fraction, then prevalence, then id; state-sized."""
    summed = mix.where(F.col("cell_subtype_label").isin(types)).groupBy("state_id").agg(F.sum("fraction").alias("selected_fraction"))
    joined = summed.join(occurrence.select("state_id", "patient_prevalence", "fov_prevalence", "n_patients_present"), "state_id", "left")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("selected_fraction", 12)), F.desc(F.round("patient_prevalence", 12)), "state_id")
    return joined.withColumn("row_position", F.row_number().over(order))


def state_domain_matrix(distribution: DataFrame, domains: list[str]) -> DataFrame:
    """Wide shares within each state, missing cells zero."""
    cell = lambda d: F.coalesce(F.max(F.when(F.col("domain_label") == d, F.col("fraction_within_community"))), F.lit(0.0))
    return distribution.groupBy("state_id").agg(*[cell(d).alias(d) for d in domains])


def type_dominant_states(mix: DataFrame, types: list[str], minimum: float = 0.5) -> DataFrame:
    summed = mix.where(F.col("cell_subtype_label").isin(types)).groupBy("state_id").agg(F.sum("fraction").alias("f"))
    return summed.where(F.col("f") > minimum).select("state_id")


def domain_rich_states(distribution: DataFrame, domain: str, minimum: float = 0.5) -> DataFrame:
    return distribution.where((F.col("domain_label") == domain) & (F.col("fraction_within_community") > minimum)).select("state_id")


def selected_states(*rules: DataFrame) -> DataFrame:
    out = rules[0]
    for rule in rules[1:]:
        out = out.union(rule)
    return out.distinct()


def stacked_families(calibration: DataFrame, supplement: DataFrame, names: list[str]) -> DataFrame:
    """Null, observed and contrast family of the burden-weighted summaries in one table."""
    cal = calibration.where((F.col("scale") == "burden_weighted") & (F.col("reference_stat") == "median") & F.col("summary_name").isin(names))
    sup = supplement.where((F.col("scale") == "burden_weighted") & F.col("summary_name").isin(names))
    none = F.lit(None).cast("double")
    one = lambda df, group, value, p, q: df.select("summary_name", F.lit(group).alias("group"), value.alias("value"), p.alias("p_value"), q.alias("q_value"))
    return (
        one(cal, "null", F.col("null_reference"), F.col("empirical_p_value"), none)
        .unionByName(one(cal, "left", F.col("real_value"), F.col("empirical_p_value"), none))
        .unionByName(one(sup, "right", F.col("right_median"), F.col("wilcoxon_p_value"), F.col("bh_q_value")))
    )


def pair_examples(contrast: DataFrame) -> DataFrame:
    """Complete estimable pairs in long form."""
    full = contrast.where("comparison_status = 'estimable' AND left_value IS NOT NULL AND right_value IS NOT NULL")
    items = F.array(
        F.struct(F.lit("left").alias("pair_family"), F.col("left_value").alias("value")),
        F.struct(F.lit("right").alias("pair_family"), F.col("right_value").alias("value")),
    )
    return full.select("patient_id", "source_community_id", "summary_name", F.inline(items))


def pair_segments(examples: DataFrame) -> DataFrame:
    """Long pairs back to one row per pair."""
    side = lambda name: F.max(F.when(F.col("pair_family") == name, F.col("value")))
    wide = examples.groupBy("patient_id", "source_community_id", "summary_name").agg(side("left").alias("value_left"), side("right").alias("value_right"))
    return wide.where("value_left IS NOT NULL AND value_right IS NOT NULL")


def example_medians(examples: DataFrame) -> DataFrame:
    return exact_median(examples, ["source_community_id", "summary_name", "pair_family"], "value", "value")


def rerun_metrics(rows: DataFrame, scaling: DataFrame, scope: list[str]) -> DataFrame:
    """Mean of each metric per rerun, with a display factor (1 when not listed)."""
    means = rows.groupBy("rerun_id", *scope, "method_name", "metric_name").agg(F.avg("value").alias("value_raw"))
    joined = means.join(F.broadcast(scaling), "metric_name", "left")
    factor = F.coalesce("display_multiplier", F.lit(1.0))
    return joined.withColumn("display_multiplier", factor).withColumn("value_display", F.col("value_raw") * factor)


def metric_ranges(metrics: DataFrame) -> DataFrame:
    span = metrics.groupBy("metric_name").agg(F.min("value_display").alias("x_min"), F.max("value_display").alias("x_max"))
    width = F.greatest(F.col("x_max") - F.col("x_min"), F.abs("x_max") * 0.25, F.lit(0.01))
    return span.withColumn("x_range", width).withColumn("x_na", F.col("x_min") + F.col("x_range") * 0.5)


def missing_slots(metrics: DataFrame, metric_names: list[str], methods: list[str]) -> DataFrame:
    """Metric and method combinations of the fixed grid without any value."""
    grid = literal_table(metrics.sparkSession, ["metric_name", "method_name"], [(a, b) for a in metric_names for b in methods])
    seen = metrics.where(F.col("value_raw").isNotNull()).select("metric_name", "method_name").distinct()
    return grid.join(seen, ["metric_name", "method_name"], "left_anti").join(F.broadcast(metric_ranges(metrics)), "metric_name", "left")


def method_pairs(metrics: DataFrame, reference: str) -> DataFrame:
    """Each method's rerun values beside the reference method's."""
    key = ["rerun_id", "metric_name"]
    ref = metrics.where(F.col("method_name") == reference).select(*key, F.col("value_raw").alias("right_value"))
    other = metrics.where(F.col("method_name") != reference).select(*key, "method_name", F.col("value_raw").alias("left_value"))
    return other.join(ref, key).withColumn("delta", F.col("left_value") - F.col("right_value"))


def normal_rank_tests(pairs: DataFrame, unit: list[str]) -> DataFrame:
    """Signed-rank sums per unit; no test with a single pair or without any difference."""
    n = pairs.where(F.col("delta").isNotNull()).groupBy(*unit).agg(F.count(F.lit(1)).alias("n_pairs"))
    sums = stats.signed_rank_sums(pairs, unit)
    joined = n.join(sums, unit, "left")
    usable = F.col("n_pairs") > 1
    return joined.select(
        *unit, "n_pairs", *[F.when(usable, F.col(c)).alias(c) for c in ("n_nonzero", "w_plus", "tie_term")]
    )


def with_normal_p(tests: DataFrame, label: str) -> DataFrame:
    """Normal-rule p, q over all tests, and strict stars."""
    p = tests.withColumn("p_value", pvalues.signed_rank_normal_p("w_plus", "n_nonzero", "tie_term"))
    return stats.with_bh(p, []).withColumn(label, stats.stars(F.col("q_value"), strict=True)).drop("n_nonzero", "w_plus", "tie_term")


def shared_reference(metrics: DataFrame, reference: str) -> DataFrame:
    """The reference averaged over the families it is shared by, then the other methods."""
    own = metrics.where(F.col("method_name") == reference).groupBy("rerun_id", "method_name", "metric_name").agg(F.avg("value_raw").alias("value_raw"))
    others = metrics.where(F.col("method_name") != reference).select("rerun_id", "method_name", "metric_name", "value_raw", "evaluation_family")
    return own.withColumn("evaluation_family", F.lit("shared_reference")).unionByName(others)


def patient_domain_fractions(cells: DataFrame, states: list[int]) -> DataFrame:
    """State share per patient and domain on the full grid of the chosen states."""
    counted = cells.groupBy("patient_id", "domain_label").agg(
        F.count(F.lit(1)).alias("domain_total_cells"), F.array(*[F.count_if(F.col("state_id") == s) for s in states]).alias("n")
    )
    items = F.arrays_zip(F.array(*[F.lit(s) for s in states]).alias("state_id"), F.col("n").alias("community_cells"))
    long = counted.select("patient_id", "domain_label", "domain_total_cells", F.inline(items)).toDF(
        "patient_id", "domain_label", "domain_total_cells", "state_id", "community_cells"
    )
    return long.withColumn("community_fraction", share(F.col("community_cells"), F.col("domain_total_cells")))


def domain_contrasts(fractions: DataFrame, contrasts: list[tuple[str, str]]) -> DataFrame:
    """Paired domain values per patient and state for each contrast."""
    names = sorted({d for pair in contrasts for d in pair})
    wide = fractions.groupBy("patient_id", "state_id").agg(
        *[F.max(F.when(F.col("domain_label") == d, F.col("community_fraction"))).alias(d) for d in names]
    )
    items = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.col(a).alias("left_value"), F.col(b).alias("right_value")) for a, b in contrasts])
    return wide.select("patient_id", "state_id", F.inline(items)).withColumn("delta", F.col("left_value") - F.col("right_value"))


def json_profiles(rows: DataFrame, x_json: str, y_json: str) -> DataFrame:
    """JSON vectors to long profiles; one row kept per (rerun, patient)."""
    kept = rows.groupBy("rerun_id", "patient_id").agg(F.min(F.struct(x_json, y_json)).alias("j"))
    parse = lambda c: F.from_json(F.col(f"j.{c}"), "array<double>")
    zipped = F.arrays_zip(parse(x_json).alias("x"), parse(y_json).alias("y"))
    return kept.select("rerun_id", "patient_id", F.posexplode(zipped).alias("feature_index", "p")).select(
        "rerun_id", "patient_id", "feature_index", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def profile_differences(profiles: DataFrame) -> DataFrame:
    """Observed and generated minus source, averaged per rerun and state, with the largest absolute mean.

    ``profiles`` is long (rerun_id, patient_id, state_id, x, observed, generated).
    """
    items = F.array(
        F.struct(F.lit("observed").alias("difference_source"), (F.col("observed") - F.col("x")).alias("d")),
        F.struct(F.lit("generated").alias("difference_source"), (F.col("generated") - F.col("x")).alias("d")),
    )
    means = profiles.select("rerun_id", "state_id", F.inline(items)).groupBy("difference_source", "rerun_id", "state_id").agg(F.avg("d").alias("mean_difference"))
    limit = means.agg(F.max(F.abs("mean_difference")).alias("difference_limit")).withColumn("one", F.lit(1))
    return means.withColumn("one", F.lit(1)).join(F.broadcast(limit), "one").drop("one")


def metric_contrasts(rerun_metrics: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """Chosen pairs of rerun metric columns as paired rows (block, label, left, right)."""
    items = F.array(
        *[
            F.struct(F.lit(block).alias("plot_block"), F.lit(label).alias("metric_label"), F.col(a).alias("left_value"), F.col(b).alias("right_value"))
            for block, label, a, b in pairs
        ]
    )
    return rerun_metrics.select("rerun_id", F.inline(items)).withColumn("delta", F.col("left_value") - F.col("right_value"))
