"""Seeded resampling and bootstrap summaries.

Draws are hashes of (seed, replicate, slot), so they do not depend on how the
data is partitioned and never need a stateful generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions.ranks import hash_positions
from fovea.schema import COORD


def draw(seed: str, *parts: Column) -> Column:
    """Non-negative integer from the first 32 bits of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, scope: list[str], key: str, seed: str) -> DataFrame:
    """Rows numbered 1..n within the scope in a fixed hash order."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key)), 256)
    return hash_positions(df.withColumn("_digest", digest), scope, "_digest", "slot", "n").drop("_digest")


def resample_weights(units: DataFrame, scope: list[str], key: str, replicates: int, seed: str) -> DataFrame:
    """How often each unit is drawn in each replicate, drawing n of n with replacement.

    Every numbered unit also acts as one slot per replicate; its draw names
    another number. Grouping by the drawn number before the join keeps the
    exchange at one row per distinct draw.
    """
    rows = numbered(units.select(*scope, key), scope, key, seed)
    slots = rows.select(*scope, "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    picked = slots.select(*scope, "replicate", (draw(seed, F.col("replicate"), F.col("slot")) % F.col("n") + 1).alias("slot"))
    counts = picked.groupBy(*scope, "replicate", "slot").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(rows.select(*scope, "slot", "n", key), [*scope, "slot"]).select(*scope, "replicate", key, "weight", "n")


def resampled_means(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """Cohort mean of every entry in every replicate."""
    joined = entries.join(weights, ["relation_id", "patient_id"])
    return joined.groupBy("relation_id", "replicate", *COORD).agg((F.sum(F.col("value") * F.col("weight")) / F.first("n")).alias("value"))


def stability(df: DataFrame, scope: list[str], value: str) -> DataFrame:
    """Mean, sample SD and coefficient of variation."""
    mean, sd = F.avg(value), F.stddev_samp(value)
    return df.groupBy(*scope).agg(mean.alias("mean"), sd.alias("sd"), (sd / F.when(mean != 0, mean)).alias("cv"))


def bootstrap_entry_summary(replicates: DataFrame, reference: DataFrame) -> DataFrame:
    """Per entry: mean, SD, non-zero frequency and deviation from the reference."""
    joined = replicates.join(reference.select("relation_id", *COORD, F.col("value").alias("ref")), ["relation_id", *COORD])
    gap = F.abs(F.col("value") - F.col("ref"))
    return joined.groupBy("relation_id", *COORD).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.avg((F.abs("value") > 1e-12).cast("double")).alias("nonzero_frequency"),
        F.sum(gap).alias("gap_sum"), F.max(gap).alias("gap_max"), F.count(F.lit(1)).alias("n"),
    )


def bootstrap_overall(per_entry: DataFrame) -> DataFrame:
    return per_entry.groupBy("relation_id", "entry_type").agg(
        (F.sum("gap_sum") / F.sum("n")).alias("mean_abs_deviation"),
        F.max("gap_max").alias("max_abs_deviation"),
        F.avg("sd").alias("mean_element_std"),
    )


def cohort_bootstrap_summary(patients: DataFrame) -> DataFrame:
    """Counts by status, mean success rate and mean element SDs, with one overall status."""
    s, eligible = F.col("uncertainty_status"), F.col("eligible")
    ok = s == "ok"
    counted = patients.agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count_if(eligible).alias("n_eligible_patients"),
        F.count_if(ok).alias("n_realized_patients"),
        F.count_if(s == "deferred").alias("n_deferred"),
        F.count_if(s == "failed").alias("n_failed"),
        F.count_if(eligible & (s == "failed")).alias("_bad"),
        F.avg(F.when(eligible, F.col("success_rate"))).alias("mean_patient_success_rate"),
        *[F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}") for c in ("A_std", "d_std", "e_std")],
    )
    overall = F.when(F.col("n_realized_patients") > 0, "ok").when(F.col("_bad") > 0, "failed").otherwise("deferred")
    return counted.withColumn("uncertainty_status", overall).drop("_bad")


def log_error(df: DataFrame, scope: list[str], value: str, shift: float = 1e-4, floor: float = 1e-6) -> DataFrame:
    """Sample variance of ``log(value + shift)`` with a floor; null below two values or with a negative one."""
    v = F.col(value)
    stats = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*scope).agg(
        F.count(v).alias("n"), F.count_if(v < 0).alias("n_negative"), F.var_samp(F.log(F.greatest(v, F.lit(0.0)) + shift)).alias("s2")
    )
    good = (F.col("n") >= 2) & (F.col("n_negative") == 0)
    return stats.select(
        *scope, "n", "n_negative",
        F.when(good, F.greatest("s2", F.lit(floor))).alias("log_variance"),
        F.when(good, F.col("s2") < floor).otherwise(False).alias("floor_applied"),
    )


BUCKETS = 1024


def weighted_quantile(df: DataFrame, scope: list[str], value: str, weight: str, q: float, *, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Quantile interpolated between the weight centres of the sorted values.

    Equal values are ordered by weight. They are collapsed first; the outermost
    centres of such a run only need its total, smallest and largest weight.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    runs = rows.groupBy(*scope, value).agg(
        F.sum(weight).alias("w"), F.min(weight).alias("w_first"), F.max(weight).alias("w_last")
    ).withColumn(
        "_b", F.floor((F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high)) - low) / (high - low) * BUCKETS)
    )
    ahead = Window.partitionBy(*scope).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = runs.groupBy(*scope, "_b").agg(F.sum("w").alias("bw")).select(
        *scope, "_b", F.coalesce(F.sum("bw").over(ahead), F.lit(0.0)).alias("before"), F.sum("bw").over(Window.partitionBy(*scope)).alias("total")
    )
    inner = Window.partitionBy(*scope, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.join(parts, [*scope, "_b"]).withColumn("start", F.col("before") + F.coalesce(F.sum("w").over(inner), F.lit(0.0)))
    first = (F.col("start") + F.col("w_first") / 2) / F.col("total")
    last = (F.col("start") + F.col("w") - F.col("w_last") / 2) / F.col("total")
    points = placed.where("total > 0").withColumn("c1", first).withColumn("c2", last)
    v = F.col(value)
    found = points.groupBy(*scope).agg(
        F.max(F.when((F.col("c1") <= q) & (F.col("c2") >= q), v)).alias("inside"),
        F.max(F.when(F.col("c2") < q, F.struct("c2", v.alias("v")))).alias("lo"),
        F.min(F.when(F.col("c1") > q, F.struct("c1", v.alias("v")))).alias("hi"),
    )
    slope = (F.col("hi.v") - F.col("lo.v")) / (F.col("hi.c1") - F.col("lo.c2"))
    between = F.col("lo.v") + slope * (F.lit(q) - F.col("lo.c2"))
    return found.select(*scope, F.coalesce("inside", between, "lo.v", "hi.v").alias("weighted_quantile"))


def _resampled_mean(values: Column, seed: str, replicate: Column) -> Column:
    """Mean of one with-replacement resample of a short array."""
    size = F.size(values)
    slots = F.sequence(F.lit(1), size)
    picked = F.transform(slots, lambda s: F.get(values, (draw(seed, replicate, s) % size).cast("int")))
    return F.aggregate(picked, F.lit(0.0), lambda a, b: a + b) / size


def mean_interval(df: DataFrame, scope: list[str], order: str, value: str, draws: int = 256, seed: str = "17") -> DataFrame:
    """Percentile bootstrap interval of a mean over a few reruns, which fit in an array."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    arrays = df.groupBy(*scope).agg(listed.alias("_v"), F.avg(value).alias("mean_value"))
    reps = arrays.select(*scope, "_v", "mean_value", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_r"))
    means = reps.withColumn("_m", _resampled_mean(F.col("_v"), seed, F.col("_r")))
    return means.groupBy(*scope).agg(
        F.first("mean_value").alias("mean_value"),
        F.percentile("_m", F.lit(0.025)).alias("ci_lower"), F.percentile("_m", F.lit(0.975)).alias("ci_upper"),
    )


def condition_summary(rows: DataFrame, reference_method: str) -> DataFrame:
    """Rerun means, their mean and interval, and the paired difference to a reference method.

    ``rows``: rerun_id, condition_id, method_name, metric_name, value, status.
    Any ``not_estimable`` row wins; only ``not_applicable`` rows give that; a
    mixture with reported rows is marked as an error.
    """
    cell = ["condition_id", "method_name", "metric_name"]
    s = F.col("status")
    states = rows.groupBy(*cell).agg(
        F.max((s == "not_estimable").cast("int")).alias("ne"), F.max((s == "not_applicable").cast("int")).alias("na"), F.max((s == "reported").cast("int")).alias("rp")
    )
    status = F.when(F.col("ne") == 1, "not_estimable").when((F.col("na") == 1) & (F.col("rp") == 1), "mixed_error").when(F.col("na") == 1, "not_applicable").otherwise("reported")
    states = states.select(*cell, status.alias("own_status"))
    reruns = rows.where(s == "reported").groupBy(*cell, "rerun_id").agg(F.avg("value").alias("m"))
    ref = reruns.where(F.col("method_name") == reference_method).select("condition_id", "metric_name", "rerun_id", F.col("m").alias("ref"))
    paired = reruns.join(ref, ["condition_id", "metric_name", "rerun_id"], "left").groupBy(*cell).agg(F.avg(F.col("m") - F.col("ref")).alias("diff"))
    ref_state = states.where(F.col("method_name") == reference_method).select("condition_id", "metric_name", F.col("own_status").alias("ref_status"))
    joined = (
        states.join(mean_interval(reruns, cell, "rerun_id", "m"), cell, "left").join(paired, cell, "left").join(ref_state, ["condition_id", "metric_name"], "left")
    )
    final = F.when((F.col("own_status") == "reported") & ~F.coalesce(F.col("ref_status") == "reported", F.lit(False)), "not_estimable").otherwise(F.col("own_status"))
    show = lambda c: F.when(F.col("status") == "reported", F.col(c))
    return joined.withColumn("status", final).select(
        *cell, "status", show("mean_value").alias("mean_value"), show("ci_lower").alias("ci_lower"), show("ci_upper").alias("ci_upper"),
        show("diff").alias("paired_difference"),
    )


def review_rows(summary: DataFrame, labels: DataFrame) -> DataFrame:
    """Condition summaries with section and condition titles."""
    return summary.join(F.broadcast(labels), "condition_id")


def rerun_variability(profiles: DataFrame, metrics: DataFrame, scope: list[str]) -> DataFrame:
    """Mean SD over profile positions plus mean SD over metrics, across reruns."""
    a = profiles.groupBy(*scope, "position").agg(F.stddev_pop("value").alias("s")).groupBy(*scope).agg(F.avg("s").alias("object_variability"))
    b = metrics.groupBy(*scope, "metric_name").agg(F.stddev_pop("value").alias("s")).groupBy(*scope).agg(F.avg("s").alias("metric_variability"))
    return a.join(b, scope).withColumn("rerun_variability", F.col("object_variability") + F.col("metric_variability"))
