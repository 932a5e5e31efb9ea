"""Group comparisons, paired contrasts, corrections and permutation calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions import pvalues
from fovea.functions.ranks import at_quantile, exact_median, value_ranks
from fovea.operators.summary import SUMMARIES
from fovea.runtime import literal_table
from fovea.schema import COORD, ZERO_BAND

# Review thresholds.
Q_ALPHA = 0.05
EFFECT_FLOOR = 0.05

# Decimals that count when values are ranked.
RANK_DIGITS = 12


# --- group association -------------------------------------------------------


def comparison_rows(entries: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Entries once per comparison that names their group, with the group's place in it."""
    named = comparisons.select("comparison_id", F.size("groups").alias("n_groups"), F.posexplode("groups").alias("place", "group_id"))
    return entries.join(F.broadcast(named), "group_id")


def group_description(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Count, mean, median and population SD of every compared group."""
    scope = [*unit, "comparison_id", "group_id"]
    plain = rows.groupBy(*scope, "place").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    return plain.join(exact_median(rows, scope, "value", "median", low=0.0, high=1.0), scope)


def described_as_maps(described: DataFrame, unit: list[str]) -> DataFrame:
    """The same description as maps by group, one row per test; groups are few."""
    def packed(column: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_id", column))))

    return described.groupBy(*unit, "comparison_id").agg(
        F.sum("n").alias("n_total"),
        *[packed(c).alias(f"{c}_by_group") for c in ("n", "mean", "median", "std")],
    )


def rank_sums(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Mann-Whitney U of the first group, group sizes, tie term and Cliff's delta per test.

    U comes from average ranks of distinct values, so no pairs are formed:
    ``delta = 2 U / (n1 n2) - 1``. Values equal to twelve decimals are tied, so
    the order of distributed sums cannot decide a rank.
    """
    scope = [*unit, "comparison_id"]
    ranked = value_ranks(
        rows.where("n_groups = 2").withColumn("value", F.round("value", RANK_DIGITS)), scope, "value", low=0.0, high=1.0, counts={"first": F.count_if(F.col("place") == 0)}
    )
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(*scope).agg(
        F.sum("first").alias("n1"),
        F.sum(F.col("ties") - F.col("first")).alias("n2"),
        F.sum(F.col("first") * F.col("avg_rank")).alias("r1"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    pairs = F.col("n1") * F.col("n2")
    return sums.select(*scope, "n1", "n2", "tie_term", u.alias("u1"), (2 * u / F.when(pairs > 0, pairs) - 1).alias("effect_size"))


def variance_parts(rows: DataFrame, unit: list[str]) -> DataFrame:
    """One-way ANOVA F and eta squared from per-group moments."""
    scope = [*unit, "comparison_id"]
    moments = rows.where("n_groups > 2").groupBy(*scope, "group_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    n, m = F.col("n"), F.col("m")
    sums = moments.groupBy(*scope).agg(
        F.sum("n").alias("nn"), F.count(F.lit(1)).alias("k"), (F.sum(n * m) / F.sum("n")).alias("grand"),
        F.sum(n * m * m).alias("nm2"), F.sum(n * F.col("v")).alias("ssw"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    ssb = F.greatest(F.col("nm2") - F.col("nn") * F.col("grand") * F.col("grand"), F.lit(0.0))
    flat = (F.col("hi") - F.col("lo")) <= 1e-8 + 1e-5 * F.abs("lo")
    parts = sums.withColumn("ssb", ssb).withColumn("flat", flat)
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("nn") - F.col("k")).cast("double")
    total = F.col("ssb") + F.col("ssw")
    return parts.select(
        *scope, "flat", df1.alias("df1"), df2.alias("df2"),
        F.when(~F.col("flat") & (F.col("ssw") > 0), (F.col("ssb") / df1) / (F.col("ssw") / df2)).alias("f_value"),
        F.when(F.col("flat") | (total <= 0), 0.0).otherwise(F.col("ssb") / total).alias("effect_size"),
    )


def with_bh(tests: DataFrame, scope: list[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q per scope; null p-values are skipped and not counted.

    A scope holds the tests of one family, a state-sized number.
    """
    known = F.col(p).isNotNull()
    n = F.count(p).over(Window.partitionBy(*scope))
    order = Window.partitionBy(*scope).orderBy(F.col(p).asc_nulls_last())
    ranked = tests.withColumn("_n", n).withColumn("_rank", F.row_number().over(order))
    raw = F.when(known, F.least(F.col(p) * F.col("_n") / F.col("_rank"), F.lit(1.0)))
    back = Window.partitionBy(*scope).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranked.withColumn("_raw", raw)
        .withColumn(q, F.when(known, F.greatest(F.min("_raw").over(back), F.lit(0.0))))
        .drop("_n", "_rank", "_raw")
    )


def group_association(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Two-group and multi-group tests per unit with BH over (relation, comparison)."""
    scope = [*unit, "comparison_id"]
    named = rows.select("comparison_id", "place", "group_id").where("place < 2").distinct()
    pair = named.groupBy("comparison_id").agg(
        F.max(F.when(F.col("place") == 0, F.col("group_id"))).alias("g1"), F.max(F.when(F.col("place") == 1, F.col("group_id"))).alias("g2")
    )
    two = rank_sums(rows, unit).join(F.broadcast(pair), "comparison_id")
    d = F.col("effect_size")
    two = two.select(
        *scope, F.lit("two_group").alias("comparison_type"), F.col("g1").alias("group_1"), F.col("g2").alias("group_2"),
        F.lit("mannwhitneyu").alias("test_name"), "effect_size", F.lit("cliffs_delta").alias("effect_size_type"),
        F.when(d > 0, F.concat("g1", F.lit(">"), "g2")).when(d < 0, F.concat("g1", F.lit("<"), "g2")).otherwise("none").alias("effect_direction"),
        pvalues.mann_whitney_p("u1", "n1", "n2", "tie_term").alias("p_value"),
    )
    many = variance_parts(rows, unit)
    p = F.when(F.col("flat"), 1.0).when(F.col("f_value").isNull(), 0.0).otherwise(pvalues.f_tail_p("f_value", "df1", "df2"))
    many = many.select(
        *scope, F.lit("multi_group").alias("comparison_type"), F.lit(None).cast("string").alias("group_1"), F.lit(None).cast("string").alias("group_2"),
        F.lit("one_way_anova").alias("test_name"), "effect_size", F.lit("eta_squared").alias("effect_size_type"),
        F.when(F.col("flat"), "none").otherwise("unsigned").alias("effect_direction"), p.alias("p_value"),
    )
    tests = two.unionByName(many).join(described_as_maps(group_description(rows, unit), unit), scope)
    out = with_bh(tests, ["relation_id", "comparison_id"])
    return out.withColumn("correction_method", F.lit("BH")).withColumn(
        "correction_scope", F.concat_ws(":", "relation_id", "comparison_id")
    )


def entry_rows(entries: DataFrame, groups: DataFrame, comparisons: DataFrame) -> DataFrame:
    return comparison_rows(entries.join(groups.select("patient_id", "group_id"), "patient_id"), comparisons)


ENTRY_UNIT = ["relation_id", *COORD]
PROGRAM_UNIT = ["relation_id", "program_id"]


# --- paired contrasts --------------------------------------------------------


def direction(delta: Column, higher: str = "left_gt_right", equal: str = "left_eq_right", lower: str = "left_lt_right") -> Column:
    return (
        F.when(delta.isNull(), "not_estimable")
        .when(F.abs(delta) <= ZERO_BAND, equal)
        .when(delta > 0, higher)
        .otherwise(lower)
    )


def paired_contrast(values: DataFrame, status: DataFrame, axis: list[str], axis_rows: list[tuple], left: str, right: str) -> DataFrame:
    """Per patient and axis item: both families' values, their difference and its status.

    ``values`` is long (relation_id, patient_id, axis..., value); a row means the
    item exists for that family. ``axis_rows`` lists the fixed items of the axis.
    """
    side = lambda rel, column: F.max(F.when(F.col("relation_id") == rel, F.col(column)))
    states = status.where(F.col("relation_id").isin(left, right)).groupBy("patient_id").agg(
        side(left, "fit_status").alias("left_fit_status"), side(right, "fit_status").alias("right_fit_status")
    )
    wide = values.where(F.col("relation_id").isin(left, right)).groupBy("patient_id", *axis).agg(
        side(left, "value").alias("lv"), side(right, "value").alias("rv"),
        F.count_if(F.col("relation_id") == left).alias("ln"), F.count_if(F.col("relation_id") == right).alias("rn"),
    )
    item = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(axis, row)]) for row in axis_rows])
    grid = states.select("*", F.inline(item))
    joined = grid.join(wide, ["patient_id", *axis], "left")
    s1 = F.coalesce("left_fit_status", F.lit("missing"))
    s2 = F.coalesce("right_fit_status", F.lit("missing"))
    has_left = (s1 == "ok") & (F.coalesce("ln", F.lit(0)) > 0)
    has_right = (s2 == "ok") & (F.coalesce("rn", F.lit(0)) > 0)
    state = F.when((s1 == "deferred") | (s2 == "deferred"), "deferred").when(has_left & has_right, "estimable").otherwise("missing")
    shown = joined.select(
        "patient_id", *axis, state.alias("comparison_status"),
        F.when((state != "deferred") & has_left, F.col("lv")).alias("left_value"),
        F.when((state != "deferred") & has_right, F.col("rv")).alias("right_value"),
        s1.alias("left_fit_status"), s2.alias("right_fit_status"),
    ).withColumn("delta", F.when(F.col("comparison_status") == "estimable", F.col("left_value") - F.col("right_value")))
    return shown.withColumn("contrast_direction", direction(F.col("delta")))


def unpivot_communities(table: DataFrame, community: str, names: list[str]) -> DataFrame:
    """Community table to long (relation, patient, community, summary_name, value)."""
    items = F.array(*[F.struct(F.lit(n).alias("summary_name"), F.col(n).alias("value")) for n in names])
    return table.select("relation_id", "patient_id", community, F.inline(items))


def cohort_contrast(template: DataFrame, summary: DataFrame, left: str, right: str) -> DataFrame:
    """Cohort templates of two relations entry by entry, with support and dispersion of each."""
    side = lambda rel, column: F.max(F.when(F.col("relation_id") == rel, F.col(column)))
    wide = template.groupBy(*COORD).agg(side(left, "value").alias("left_value"), side(right, "value").alias("right_value"))
    facts = summary.agg(
        side(left, "support_n_patients").alias("left_support"), side(right, "support_n_patients").alias("right_support"),
        side(left, "dispersion").alias("left_dispersion"), side(right, "dispersion").alias("right_dispersion"),
    ).withColumn("one", F.lit(1))
    out = wide.withColumn("delta", F.col("left_value") - F.col("right_value")).withColumn("one", F.lit(1)).join(F.broadcast(facts), "one").drop("one")
    return out.withColumn("contrast_direction", direction(F.col("delta")))


def signed_rank_sums(pairs: DataFrame, unit: list[str], band: float = ZERO_BAND) -> DataFrame:
    """Positive rank sum, count and tie term of the non-zero differences per unit."""
    moved = pairs.where(F.col("delta").isNotNull() & (F.abs("delta") > band)).select(
        *unit, F.round(F.abs("delta"), RANK_DIGITS).alias("size"), (F.col("delta") > 0).alias("up")
    )
    ranked = value_ranks(moved, unit, "size", low=0.0, high=1.0, counts={"ups": F.count_if("up")})
    t = F.col("ties").cast("double")
    return ranked.groupBy(*unit).agg(
        F.sum("ties").alias("n_nonzero"),
        F.sum(F.col("ups") * F.col("avg_rank")).alias("w_plus"),
        F.sum(t * t * t - t).alias("tie_term"),
    )


def paired_payload(pairs: DataFrame, unit: list[str]) -> DataFrame:
    """Counts, shares, medians, effect flag and both tests of the paired differences."""
    full = pairs.where(F.col("left_value").isNotNull() & F.col("right_value").isNotNull() & F.col("delta").isNotNull())
    up, down = F.col("delta") > ZERO_BAND, F.col("delta") < -ZERO_BAND
    counts = full.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if(up).alias("support_positive_n"),
        F.count_if(down).alias("support_negative_n"),
        F.count_if(~up & ~down).alias("support_zero_n"),
        F.avg("delta").alias("mean_delta"),
    )
    measures = ("left_value", "right_value", "delta")
    long = full.select(*unit, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures])))
    medians = (
        value_ranks(long, [*unit, "measure"], "v")
        .groupBy(*unit, "measure")
        .agg(at_quantile("v", 0.5).alias("m"))
        .groupBy(*unit)
        .agg(*[F.max(F.when(F.col("measure") == m, F.col("m"))).alias(a) for m, a in zip(measures, ("left_median", "right_median", "median_delta"))])
    )
    sums = signed_rank_sums(full, unit)
    joined = counts.join(medians, unit).join(sums, unit, "left")
    n = F.col("n_patients")
    return joined.select(
        *unit, "n_patients", F.coalesce("n_nonzero", F.lit(0)).cast("long").alias("n_nonzero_delta"),
        "support_positive_n", "support_negative_n", "support_zero_n",
        (F.col("support_positive_n") / n).alias("support_positive_fraction"),
        (F.col("support_negative_n") / n).alias("support_negative_fraction"),
        "left_median", "right_median", "median_delta", "mean_delta",
        F.abs("median_delta").alias("abs_median_delta"),
        direction(F.col("median_delta")).alias("contrast_direction"),
        (F.abs("median_delta") >= EFFECT_FLOOR).alias("effect_floor_pass"),
        "w_plus", "tie_term",
    )


def with_paired_tests(payload: DataFrame) -> DataFrame:
    return payload.withColumn("wilcoxon_p_value", pvalues.signed_rank_p("w_plus", "n_nonzero_delta", "tie_term")).withColumn(
        "sign_test_p_value", pvalues.sign_test_p("support_positive_n", "support_negative_n")
    )


def with_review_flags(tests: DataFrame, scope: list[str]) -> DataFrame:
    flagged = with_bh(tests, scope, "wilcoxon_p_value", "bh_q_value")
    q_pass = F.coalesce(F.col("bh_q_value") <= Q_ALPHA, F.lit(False))
    return flagged.withColumn("q_pass", q_pass).withColumn("review_candidate", q_pass & F.coalesce("effect_floor_pass", F.lit(False)))


def paired_supplement(contrast: DataFrame, unit: list[str]) -> DataFrame:
    """Statistics of the estimable rows of a contrast, corrected over the whole table."""
    payload = paired_payload(contrast.where("comparison_status = 'estimable'"), unit)
    return with_review_flags(with_paired_tests(payload), []).drop("w_plus", "tie_term")


def element_pairs(entries: DataFrame, left: str, right: str) -> DataFrame:
    """Matched patients' A, d and e entries of two relations."""
    side = lambda rel: F.max(F.when(F.col("relation_id") == rel, F.col("value")))
    wide = entries.where(F.col("relation_id").isin(left, right)).groupBy("patient_id", *COORD).agg(
        side(left).alias("left_value"), side(right).alias("right_value")
    )
    return wide.where("left_value IS NOT NULL AND right_value IS NOT NULL").withColumn("delta", F.col("left_value") - F.col("right_value"))


def element_supplement(entries: DataFrame, left: str, right: str) -> DataFrame:
    """Paired statistics of every relation entry, corrected per component."""
    payload = paired_payload(element_pairs(entries, left, right), COORD)
    return with_review_flags(with_paired_tests(payload), ["entry_type"]).drop("w_plus", "tie_term")


# --- permutation calibration -------------------------------------------------


def in_tail(observed: Column, reference: Column, tail: Column) -> Column:
    """Inclusive tail; an identity permutation equals the observed value despite summation order."""
    observed, reference = F.round(observed, RANK_DIGITS), F.round(reference, RANK_DIGITS)
    return F.when(tail == "right", reference >= observed).otherwise(reference <= observed)


def tail_columns(observed: Column, reference: Column, tail: Column) -> list[Column]:
    """Aggregates of a null distribution against one observed value."""
    opposite = F.when(tail == "right", "left").otherwise("right")
    hit = in_tail(observed, reference, tail).cast("int")
    return [
        ((1 + F.sum(hit)) / (1 + F.count(reference))).alias("empirical_p_value"),
        F.avg(hit).alias("primary_tail_fraction"),
        F.avg(in_tail(observed, reference, opposite).cast("int")).alias("opposite_tail_fraction"),
    ]


def effect_columns(observed: str, reference: str) -> list[Column]:
    r = F.col(reference)
    small = F.abs(r) <= ZERO_BAND
    return [
        (F.col(observed) - r).alias("effect_delta"),
        (F.col(observed) / F.when(~small, r)).alias("effect_ratio"),
        F.when(small, "not_estimable").otherwise("estimable").alias("effect_ratio_status"),
    ]


def _tails(spark) -> DataFrame:
    return literal_table(spark, ["summary_name", "expected_tail"], [(n, t) for n, _, _, t in SUMMARIES])


_SUMMARY = ["summary_name", "scale"]


def _by_stat(median: str, mean: str, alias: str) -> Column:
    return F.inline(
        F.array(
            F.struct(F.lit("median").alias("reference_stat"), F.col(median).alias(alias)),
            F.struct(F.lit("mean").alias("reference_stat"), F.col(mean).alias(alias)),
        )
    )


def patient_calibration(real: DataFrame, null: DataFrame) -> DataFrame:
    """Observed summaries of each patient against its own permutations.

    A group holds one patient's permutations of one summary: their number is
    fixed by the calibration, so the built-in median is bounded.
    """
    both = null.select("patient_id", *_SUMMARY, F.col("value").alias("null_value")).join(
        real.select("patient_id", *_SUMMARY, F.col("value").alias("real_value")), ["patient_id", *_SUMMARY]
    ).join(F.broadcast(_tails(real.sparkSession)), "summary_name")
    stats = both.groupBy("patient_id", *_SUMMARY, "expected_tail").agg(
        F.first("real_value").alias("real_value"),
        F.median("null_value").alias("med"),
        F.avg("null_value").alias("avg"),
        *tail_columns(F.col("real_value"), F.col("null_value"), F.col("expected_tail")),
    )
    keep = ["patient_id", *_SUMMARY, "expected_tail", "real_value", "empirical_p_value", "primary_tail_fraction", "opposite_tail_fraction"]
    rows = stats.select(*keep, _by_stat("med", "avg", "null_reference"))
    return rows.select("*", *effect_columns("real_value", "null_reference"))


def _cohort_stats(df: DataFrame, scope: list[str]) -> DataFrame:
    """Median and mean over patients, as rows per reference statistic."""
    mean = df.groupBy(*scope).agg(F.avg("value").alias("avg"))
    both = mean.join(exact_median(df, scope, "value", "med", low=0.0, high=1.0), scope)
    return both.select(*scope, _by_stat("med", "avg", "cohort_value"))


def cohort_calibration(real: DataFrame, null: DataFrame) -> DataFrame:
    """Cohort statistics against the cohort statistics of every permutation, with patient sign counts."""
    observed = _cohort_stats(real, _SUMMARY).withColumnRenamed("cohort_value", "real_value")
    reference = _cohort_stats(null, [*_SUMMARY, "permutation_index"])
    both = reference.join(F.broadcast(observed), [*_SUMMARY, "reference_stat"]).join(F.broadcast(_tails(real.sparkSession)), "summary_name")
    stats = both.groupBy(*_SUMMARY, "reference_stat", "expected_tail").agg(
        F.first("real_value").alias("real_value"),
        F.when(F.col("reference_stat") == "median", F.median("cohort_value")).otherwise(F.avg("cohort_value")).alias("null_reference"),
        *tail_columns(F.col("real_value"), F.col("cohort_value"), F.col("expected_tail")),
    )
    signs = patient_calibration(real, null).groupBy(*_SUMMARY, "reference_stat").agg(
        F.count_if(F.col("effect_delta") > ZERO_BAND).alias("n_patient_delta_positive"),
        F.count_if(F.col("effect_delta") < -ZERO_BAND).alias("n_patient_delta_negative"),
        F.count_if(F.abs("effect_delta") <= ZERO_BAND).alias("n_patient_delta_zero"),
    )
    return stats.select("*", *effect_columns("real_value", "null_reference")).join(signs, [*_SUMMARY, "reference_stat"])


# --- display labels ----------------------------------------------------------


def stars(value: Column, strict: bool = False) -> Column:
    """Significance stars; ``strict`` uses < for the two upper levels."""
    top, mid = (value < 0.001, value < 0.01) if strict else (value <= 0.001, value <= 0.01)
    return F.when(value.isNull(), "ns").when(top, "***").when(mid, "**").when(value <= 0.05, "*").otherwise("ns")


def size_level(q: Column) -> Column:
    score = -F.log10(q)
    return F.when(q <= 0, 4).otherwise(F.least(F.greatest(F.floor(score), F.lit(0)), F.lit(4))).cast("int")


def panel_matches(stats: DataFrame, panels: DataFrame, key: list[str]) -> DataFrame:
    """How many panels every external statistics row matches; exactly one is valid."""
    counted = panels.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return stats.join(counted, key, "left").withColumn("n_panels", F.coalesce("n", F.lit(0)).cast("long")).drop("n").withColumn(
        "match_status", F.when(F.col("n_panels") == 1, "ok").when(F.col("n_panels") == 0, "no_panel").otherwise("ambiguous")
    )
