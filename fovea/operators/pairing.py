"""Relation support, ordered bags, paired blocks, permutations and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions.ranks import hash_positions, ordered_positions
from fovea.runtime import literal_table, spread, write_stage
from fovea.schema import FOV_KEYS, REL_PATIENT


def relation_fovs(fovs: DataFrame, sides: DataFrame) -> DataFrame:
    """FOVs selected by each side of each relation."""
    return fovs.join(sides, ["timepoint", "domain_label"]).select(
        "relation_id", "patient_id", "side", "timepoint", "domain_label", "fov_id"
    )


def relation_support(selected: DataFrame) -> DataFrame:
    """FOVs per side and patient; eligible when both sides are present."""
    counted = selected.groupBy(*REL_PATIENT).agg(
        F.count_if(F.col("side") == "source").alias("n_source"),
        F.count_if(F.col("side") == "target").alias("n_target"),
    )
    return counted.withColumn(
        "status",
        F.when((F.col("n_source") > 0) & (F.col("n_target") > 0), "eligible")
        .when(F.col("n_source") > 0, "missing_target")
        .otherwise("missing_source"),
    )


def relation_report(relations: DataFrame, support: DataFrame) -> DataFrame:
    """One row per declared relation, including those without any eligible patient."""
    counted = support.groupBy("relation_id").agg(
        F.count_if(F.col("status") == "eligible").alias("e"),
        F.count_if(F.col("status") != "eligible").alias("s"),
        F.sum("n_source").alias("ns"),
        F.sum("n_target").alias("nt"),
    )

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    return relations.join(counted, "relation_id", "left").select(
        "relation_index",
        "relation_id",
        zero("e").alias("n_eligible_patients"),
        zero("s").alias("n_skipped_patients"),
        zero("ns").alias("n_source_rows"),
        zero("nt").alias("n_target_rows"),
        F.when(zero("e") > 0, "fit").otherwise("no_eligible_patients").alias("relation_status"),
    )


def ordered_bags(selected: DataFrame) -> DataFrame:
    """Position of each FOV in its bag, ordered by FOV id then domain."""
    return ordered_positions(selected, [*REL_PATIENT, "side"], ["fov_id", "domain_label"], "position", "n_side")


def part_index(position: Column, size: Column, parts: Column) -> Column:
    """Part of a 0-based position when ``size`` items are cut into balanced parts.

    The first ``size mod parts`` parts are one longer.
    """
    base, extra = F.floor(size / parts), size % parts
    head = extra * (base + 1)
    return F.when(position < head, F.floor(position / (base + 1))).otherwise(extra + F.floor((position - head) / base)).cast("int")


def evidence_blocks(bags: DataFrame, support: DataFrame) -> DataFrame:
    """Pair part t of the source bag with part t of the target bag."""
    eligible = support.where("status = 'eligible'").select(
        *REL_PATIENT, F.least("n_source", "n_target").alias("n_parts")
    )
    return bags.join(eligible, REL_PATIENT).select(
        *REL_PATIENT,
        part_index(F.col("position") - 1, F.col("n_side"), F.col("n_parts")).alias("subbag_index"),
        "side",
        "fov_id",
        "timepoint",
        "domain_label",
    )


def with_block_id(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn(
        "block_id", F.concat(F.col("patient_id"), F.lit(":subbag_"), F.col("subbag_index").cast("string"))
    )


#: FOVs of one side of a block that one join key holds.
BLOCK_ROWS = 2048


def block_pairs(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """FOV pairs inside each block, with both composition vectors.

    As many parts as the smaller bag has FOVs means one side of every block is
    a single FOV, so the pairs grow linearly with the FOVs. A side of many FOVs is cut
    into parts that the other side is copied to, so that no task joins a whole large block.
    """
    # merged: all these tables grow with the FOVs, and compressed sizes would let them be broadcast
    rows = blocks.join(vectors.drop("domain_label").hint("merge"), ["patient_id", "timepoint", "fov_id"])
    key = [*REL_PATIENT, "subbag_index"]
    count = lambda side: F.greatest(F.ceil(F.count_if(F.col("side") == side) / BLOCK_ROWS), F.lit(1)).cast("int")
    parts = blocks.groupBy(*key).agg(count("source").alias("source_parts"), count("target").alias("target_parts"))
    sized = rows.join(parts.hint("merge"), key)
    own = {side: F.pmod(F.xxhash64("fov_id"), F.col(f"{side}_parts")).cast("int") for side in ("source", "target")}
    every = {side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_parts") - 1)) for side in ("source", "target")}

    def one(side: str, other: str, fov: str, vec: str) -> DataFrame:
        chosen = sized.where(F.col("side") == side)
        return chosen.select(*key, F.col("fov_id").alias(fov), F.col("fractions").alias(vec), own[side].alias(f"{side}_part"), every[other].alias(f"{other}_part"))

    parted = [*key, "source_part", "target_part"]
    joined = one("source", "target", "source_fov_id", "a").join(one("target", "source", "target_fov_id", "b").hint("merge"), parted).drop("source_part", "target_part")
    return joined.withColumn(
        "pair_id",
        F.concat_ws("|", "relation_id", "patient_id", F.col("subbag_index").cast("string"), "source_fov_id", "target_fov_id"),
    )


def bag_pair_summary(composition: DataFrame, sides: DataFrame) -> DataFrame:
    """What the full product of two bags would show, without forming the product.

    Pair counts and per-state means over all pairs factor into bag moments.
    """
    moments = composition.join(sides, ["timepoint", "domain_label"]).groupBy(*REL_PATIENT, "state_id").agg(
        F.count_if(F.col("side") == "source").alias("n_source"),
        F.count_if(F.col("side") == "target").alias("n_target"),
        F.avg(F.when(F.col("side") == "source", F.col("fraction"))).alias("mean_source"),
        F.avg(F.when(F.col("side") == "target", F.col("fraction"))).alias("mean_target"),
    )
    return moments.where("n_source > 0 AND n_target > 0").select(
        *REL_PATIENT,
        "state_id",
        (F.col("n_source") * F.col("n_target")).alias("n_pairs"),
        (F.col("mean_source") + F.col("mean_target")).alias("mean_combined"),
        (F.col("mean_source") * F.col("mean_target")).alias("mean_product"),
    )


def patient_inputs(fovs: DataFrame, groups: DataFrame, domains: list[str]) -> DataFrame:
    """Observation counts per patient by group and domain."""
    counts = fovs.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.count_if(F.col("timepoint") == "pre").alias("n_pre"),
        F.count_if(F.col("timepoint") == "post").alias("n_post"),
        *[F.count_if(F.col("domain_label") == d).alias(f"n_{d}") for d in domains],
    )
    return counts.join(groups.select("patient_id", "group_id"), "patient_id", "left")


def permuted_labels(fovs: DataFrame, n_permutations: int, master_seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Within-patient shuffles of the domain labels of (FOV key, domain_label) rows.

    The FOVs are ordered by a seeded hash and receive the patient's labels in
    name order, so every label keeps its exact count. ``keep`` names further columns
    of ``fovs`` that stay beside the labels.

    A permutation is fixed by the last hash of every label. Bucket counts tell which
    bucket holds it, only that bucket is sorted, and the FOVs meet the last hashes as
    one row per patient: copies of FOVs are never shuffled or joined.
    """
    fovs = spread(fovs.select(*FOV_KEYS, F.col("domain_label").alias("original_domain_label"), *keep), *FOV_KEYS)
    scope = ["permutation_index", "patient_id"]
    labels = fovs.groupBy("patient_id", "original_domain_label").agg(F.count(F.lit(1)).alias("n"))
    counts = labels.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("original_domain_label", "n"))).alias("labels"))
    # (upto, label): place of the last FOV that receives a label
    ends = counts.select(
        "patient_id",
        F.transform(
            "labels",
            lambda item, i: F.struct(
                F.aggregate(F.slice("labels", F.lit(1), i + 1), F.lit(0).cast("long"), lambda seen, one: seen + one["n"]).alias("upto"),
                item["original_domain_label"].alias("label"),
            ),
        ).alias("ends"),
    )

    def drawn(rows: DataFrame) -> DataFrame:
        seed = F.sha2(
            F.concat_ws(
                "|", F.lit("within_patient_domain_labels"), F.lit(str(master_seed)), "patient_id", F.col("permutation_index").cast("string")
            ),
            256,
        )
        draw = F.concat_ws("|", F.sha2(F.concat_ws("|", "seed", "timepoint", "fov_id"), 256), "original_domain_label")
        return rows.withColumn("seed", F.substring(seed, 1, 8)).withColumn("draw", draw).withColumn("bucket", F.substring("draw", 1, 2))

    every = fovs.withColumn("permutation_index", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    sizes = drawn(every).groupBy(*scope, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*scope).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sizes.withColumn("before", before).join(ends, "patient_id").select(*scope, "bucket", "before", "n", F.explode("ends").alias("end"))
    last = last.where("before < end.upto AND end.upto <= before + n").select(*scope, "bucket", "end.label", (F.col("end.upto") - F.col("before")).cast("int").alias("place"))

    def by_patient(table: DataFrame, columns: list[str], alias: str) -> DataFrame:
        return write_stage(table.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(alias)).groupBy("patient_id").agg(F.collect_list(F.struct("permutation_index", alias)).alias("permutations")), alias)

    wanted = by_patient(last, ["label", "bucket", "place"], "wanted")
    near = drawn(fovs.select(*FOV_KEYS, "original_domain_label").join(wanted, "patient_id").selectExpr(*FOV_KEYS, "original_domain_label", "inline(permutations)"))
    near = near.select(*scope, "draw", "bucket", F.explode("wanted").alias("w")).where("bucket = w.bucket")
    cuts = near.groupBy(*scope, F.col("w.label").alias("label"), F.col("w.place").alias("place")).agg(F.array_sort(F.collect_list("draw")).alias("draws"))
    cuts = by_patient(cuts.select(*scope, "label", F.get("draws", F.col("place") - 1).alias("cut")), ["label", "cut"], "cuts")
    placed = drawn(fovs.join(cuts, "patient_id").selectExpr(*FOV_KEYS, "original_domain_label", *keep, "inline(permutations)"))
    return placed.select(
        "permutation_index",
        *FOV_KEYS,
        "original_domain_label",
        F.get(F.filter("cuts", lambda c: F.col("draw") <= c["cut"]), F.lit(0))["label"].alias("permuted_domain_label"),
        "seed",
        *keep,
    )


def permuted_endpoints(vectors: DataFrame, assignments: DataFrame, source: str, target: str, n_states: int) -> DataFrame:
    """Patient mean vectors of both sides after relabelling, per permutation."""
    return labelled_endpoints(assignments.join(vectors.select(*FOV_KEYS, "fractions"), FOV_KEYS), source, target, n_states)


def labelled_endpoints(rows: DataFrame, source: str, target: str, n_states: int) -> DataFrame:
    """Patient mean vectors of both sides from relabelled FOVs with their ``fractions``, per permutation.

    Averages are taken state by state on the FOV arrays, so a map task ships one
    row per (permutation, patient).
    """

    def mean(label: str) -> Column:
        chosen = F.col("permuted_domain_label") == label
        return F.array(*[F.avg(F.when(chosen, F.get("fractions", F.lit(k)))) for k in range(n_states)])

    return rows.groupBy("permutation_index", "patient_id").agg(mean(source).alias("x"), mean(target).alias("y"))


def patient_splits(patients: DataFrame, n_test: int, n_reruns: int, seed: int) -> DataFrame:
    """Seeded train/test split per rerun: the ``n_test`` smallest hashes are held out."""
    spread = patients.select(
        "patient_id", F.explode(F.sequence(F.lit(0), F.lit(n_reruns - 1))).alias("rerun_index")
    ).withColumn("draw", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("rerun_index").cast("string"), "patient_id"), 256))
    placed = hash_positions(spread, ["rerun_index"], "draw", "place", "n_patients")
    return placed.select(
        "rerun_index", "patient_id", F.when(F.col("place") <= n_test, "test").otherwise("train").alias("split")
    )


def requested_patients(df: DataFrame, patients: list[str]) -> DataFrame:
    """Rows of the requested patients with the requested order."""
    wanted = literal_table(df.sparkSession, ["patient_order", "patient_id"], list(enumerate(patients)))
    return df.join(wanted, "patient_id")
