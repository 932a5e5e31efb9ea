"""Relation programs: non-negative tensor factors of the patients' relations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.runtime import durable, literal_table
from fovea.schema import ENTRY_KEYS

RESTART = ["relation_id", "rank_patient", "rank_source", "rank_target_open", "restart_id"]
MAX_PASSES = 100
INNER_STEPS = 20
TOL = 1e-8


def tensor_entries(entries: DataFrame) -> DataFrame:
    """Source x (target + open) cells of every patient: A, and d as the last column."""
    return entries.where(F.col("entry_type").isin("A", "d")).select(*ENTRY_KEYS, "value")


def tensor_problems(entries: DataFrame) -> DataFrame:
    """Negative cells and repeated patients of a tensor."""
    cells = tensor_entries(entries)
    negative = cells.where(F.col("value") < 0).groupBy("relation_id", "patient_id").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("negative"))
    again = cells.groupBy("relation_id", "patient_id", "row_id", "col_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    again = again.groupBy("relation_id", "patient_id").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("repeated"))
    return negative.unionByName(again)


def tensor_rows(entries: DataFrame, n_states: int) -> DataFrame:
    """One row per patient with its flattened K x (K+1) slice; a state-sized list.

    A patient whose slice has missing, repeated or null cells raises.
    """
    ordered = F.array_sort(F.collect_list(F.struct("row_id", "col_id", "value")))
    rows = tensor_entries(entries).groupBy("relation_id", "patient_id").agg(F.transform(ordered, lambda s: s["value"]).alias("cells"))
    whole = (F.size("cells") == n_states * (n_states + 1)) & ~F.exists("cells", lambda v: v.isNull())
    refusal = F.raise_error(F.concat(F.lit("incomplete relation of patient "), F.coalesce("patient_id", F.lit("null"))))
    return rows.withColumn("cells", F.when(whole, F.col("cells")).otherwise(refusal))


# --- decomposition -----------------------------------------------------------
# With source, target and core factors fixed, every patient's loadings follow
# from its own row. With the loadings fixed, the other factors only need the two
# small sums  U'X  and  U'U . A pass is therefore one scan of the patient rows
# that emits those sums per batch, plus state-sized updates outside.


def _columnwise(gram: np.ndarray, cross: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative least squares for all rows at once by cyclic column updates."""
    x = start
    for _ in range(steps):
        for c in range(gram.shape[0]):
            if gram[c, c] > 0:
                x[:, c] = np.maximum(x[:, c] + (cross[:, c] - x @ gram[:, c]) / gram[c, c], 0.0)
    return x


def _loadings(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Patient loadings of rows ``x`` on ``basis`` (patient rank x cells)."""
    gram, cross = basis @ basis.T, x @ basis.T
    start = np.full((x.shape[0], basis.shape[0]), 1.0)
    return _columnwise(gram, cross, start, INNER_STEPS)


def _sums_of_batches(fits: dict, rank_of: dict):
    """Batch function: the sums every running fit needs from a batch of patient rows."""

    def run(batches):
        for batch in batches:
            for relation, part in batch.groupby("relation_id"):
                x = np.stack(part["cells"].to_numpy())
                for key, basis in fits.items():
                    if key[0] != relation:
                        continue
                    u = _loadings(x, basis)
                    gap = ((x - u @ basis) ** 2).sum()
                    flat = np.concatenate([(u.T @ x).ravel(), (u.T @ u).ravel(), [gap, (x * x).sum()]])
                    yield pd.DataFrame({"fit": [rank_of[key]] * flat.size, "pos": np.arange(flat.size), "v": flat})

    return run


def _start(rank: tuple[int, int, int], n_states: int, seed: int):
    rng = np.random.default_rng(seed)
    r1, r2, r3 = rank
    return rng.random((n_states, r2)), rng.random((n_states + 1, r3)), rng.random((r1, r2, r3))


def _basis(source: np.ndarray, target: np.ndarray, core: np.ndarray) -> np.ndarray:
    return np.einsum("abc,ib,jc->aij", core, source, target).reshape(core.shape[0], -1)


def _update(source, target, core, ux: np.ndarray, uu: np.ndarray):
    """Multiplicative updates of the state-sized factors from the patient sums."""
    r1, k = core.shape[0], source.shape[0]
    cross = ux.reshape(r1, k, k + 1)
    eps = 1e-12
    for _ in range(INNER_STEPS):
        half = np.einsum("abc,jc->abj", core, target)
        num = np.einsum("aij,abj->ib", cross, half)
        den = source @ np.einsum("ad,abj,dej->be", uu, half, half)
        source = source * num / np.maximum(den, eps)
        half = np.einsum("abc,ib->aic", core, source)
        num = np.einsum("aij,aic->jc", cross, half)
        den = target @ np.einsum("ad,aic,die->ce", uu, half, half)
        target = target * num / np.maximum(den, eps)
        num = np.einsum("aij,ib,jc->abc", cross, source, target)
        den = np.einsum("ad,dbc,be,cf->aef", uu, core, source.T @ source, target.T @ target)
        core = core * num / np.maximum(den, eps)
    return source, target, core


def decompose(entries: DataFrame, rank_grid: list[tuple[int, int, int]], n_restarts: int, n_states: int, seed: int = 0) -> dict:
    """Fit every (relation, rank, restart) together; all fits share each pass over the patients.

    Returns state-sized factors and errors per fit; failures carry a message.
    """
    rows = durable(tensor_rows(entries, n_states))
    relations = [r["relation_id"] for r in rows.select("relation_id").distinct().collect()]
    state, done = {}, {}
    for relation in sorted(relations):
        for rank in rank_grid:
            for restart in range(n_restarts):
                key = (relation, *rank, restart)
                if min(rank) < 1 or rank[1] > n_states or rank[2] > n_states + 1:
                    done[key] = {"status": "failed", "error_message": f"rank {rank} does not fit {n_states} states"}
                else:
                    state[key] = _start(rank, n_states, seed + restart)
    previous: dict = {}
    for _ in range(MAX_PASSES):
        if not state:
            break
        names = {key: i for i, key in enumerate(sorted(state))}
        fits = {key: _basis(*parts) for key, parts in state.items()}
        sums = rows.mapInPandas(_sums_of_batches(fits, names), "fit int, pos int, v double").groupBy("fit", "pos").agg(F.sum("v").alias("v"))
        flat: dict = {}
        for r in sums.collect():
            flat.setdefault(r["fit"], {})[r["pos"]] = r["v"]
        for key, i in names.items():
            r1, m = key[1], n_states * (n_states + 1)
            values = np.array([flat[i][p] for p in range(r1 * m + r1 * r1 + 2)])
            error, norm = math.sqrt(max(values[-2], 0.0)), math.sqrt(values[-1])
            relative = error / norm if norm > 0 else error
            source, target, core = state[key]
            done[key] = {"status": "ok", "error": error, "relative": relative, "source": source, "target": target, "core": core}
            if abs(previous.get(key, math.inf) - relative) < TOL:
                del state[key]
                continue
            previous[key] = relative
            state[key] = _update(source, target, core, values[: r1 * m].reshape(r1, m), values[r1 * m : r1 * m + r1 * r1].reshape(r1, r1))
    return {"rows": rows, "fits": done}


def rank_diagnostics(spark, fitted: dict) -> DataFrame:
    rows = []
    for (relation, a, b, c, restart), fit in sorted(fitted["fits"].items()):
        rows.append((relation, a, b, c, restart, fit["status"], fit.get("error"), fit.get("relative"), fit.get("error_message")))
    names = [*RESTART, "status", "reconstruction_error", "relative_error", "error_message"]
    schema = "relation_id string, rank_patient int, rank_source int, rank_target_open int, restart_id int, status string, reconstruction_error double, relative_error double, error_message string"
    return spark.createDataFrame(rows, schema).select(*names)


def factor_tables(spark, fitted: dict, chosen: list[tuple]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Patient, source, target-open and core tables of the chosen fits, before normalisation."""
    source, target, core, bases = [], [], [], {}
    for key in chosen:
        fit, relation = fitted["fits"][key], key[0]
        bases[relation] = _basis(fit["source"], fit["target"], fit["core"])
        source += [(relation, i, b, float(v)) for (i, b), v in np.ndenumerate(fit["source"])]
        target += [(relation, i, b, float(v)) for (i, b), v in np.ndenumerate(fit["target"])]
        core += [(relation, a, b, c, float(v)) for (a, b, c), v in np.ndenumerate(fit["core"])]

    def load(batches):
        for batch in batches:
            for relation, part in batch.groupby("relation_id"):
                if relation in bases:
                    u = _loadings(np.stack(part["cells"].to_numpy()), bases[relation])
                    yield pd.DataFrame({"relation_id": relation, "patient_id": part["patient_id"].to_numpy(), "loading": list(u)})

    wide = fitted["rows"].mapInPandas(load, "relation_id string, patient_id string, loading array<double>")
    patient = wide.select("relation_id", "patient_id", F.posexplode("loading").alias("factor_id", "loading"))
    return (
        patient,
        literal_table(spark, ["relation_id", "axis_id", "factor_id", "loading"], source),
        literal_table(spark, ["relation_id", "axis_id", "factor_id", "loading"], target),
        literal_table(spark, ["relation_id", "patient_factor_id", "source_factor_id", "target_open_factor_id", "weight"], core),
    )


# --- tables ------------------------------------------------------------------


def best_restarts(diagnostics: DataFrame) -> DataFrame:
    """Restart with the smallest relative error per relation and rank."""
    rank = ["relation_id", "rank_patient", "rank_source", "rank_target_open"]
    ok = diagnostics.where("status = 'ok'")
    best = ok.groupBy(*rank).agg(F.min(F.struct("relative_error", "restart_id")).alias("b"))
    return best.select(*rank, F.col("b.restart_id").alias("restart_id"), F.col("b.relative_error").alias("relative_error"))


def failed_ranks(diagnostics: DataFrame) -> DataFrame:
    """Ranks without any usable restart."""
    rank = ["relation_id", "rank_patient", "rank_source", "rank_target_open"]
    return diagnostics.groupBy(*rank).agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count(F.lit(1)).alias("n")).where("n_ok = 0").drop("n_ok")


def factor_sums(factor: DataFrame) -> DataFrame:
    """Column sums of a factor; a handful of rows per relation."""
    return factor.groupBy("relation_id", "factor_id").agg(F.sum("loading").alias("scale"))


def normalized_factor(factor: DataFrame, sums: DataFrame) -> DataFrame:
    """Columns scaled to sum one; an empty column stays as it is."""
    joined = factor.join(F.broadcast(sums), ["relation_id", "factor_id"])
    return joined.withColumn("loading", F.when(F.col("scale") > 0, F.col("loading") / F.col("scale")).otherwise(F.col("loading"))).drop("scale")


def normalized_core(core: DataFrame, patient: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The core takes over the column sums; an empty column zeroes its slice."""
    out = core
    for name, sums in (("patient_factor_id", patient), ("source_factor_id", source), ("target_open_factor_id", target)):
        renamed = sums.select("relation_id", F.col("factor_id").alias(name), F.greatest("scale", F.lit(0.0)).alias("s"))
        out = out.join(F.broadcast(renamed), ["relation_id", name]).withColumn("weight", F.col("weight") * F.col("s")).drop("s")
    return out.select(*core.columns)


def program_table(core: DataFrame) -> DataFrame:
    """One program per core cell, ranked by weight then id; a rank-sized table per relation.

    Weights equal to twelve decimals count as tied, so summation order cannot decide a rank.
    """
    parts = [F.lit("p"), F.col("patient_factor_id").cast("string"), F.lit("_s"), F.col("source_factor_id").cast("string"), F.lit("_t"), F.col("target_open_factor_id").cast("string")]
    named = core.withColumn("program_id", F.concat(*parts))
    order = Window.partitionBy("relation_id").orderBy(F.desc(F.round("weight", 12)), "program_id")
    return named.withColumn("program_weight_rank", F.row_number().over(order)).withColumnRenamed("weight", "core_weight")


def axis_type(axis: Column, n_states: int) -> Column:
    return F.when(axis < n_states, "target_community").otherwise("source_open")


def target_factor_table(factor: DataFrame, n_states: int) -> DataFrame:
    return factor.withColumn("target_open_axis_type", axis_type(F.col("axis_id"), n_states))


def program_entries(programs: DataFrame, source: DataFrame, target: DataFrame, n_states: int) -> DataFrame:
    """Weight times source loading times target loading, per program."""
    s = source.select("relation_id", F.col("axis_id").alias("source_community_id"), F.col("factor_id").alias("source_factor_id"), F.col("loading").alias("ls"))
    t = target.select("relation_id", F.col("axis_id").alias("target_open_axis_id"), F.col("factor_id").alias("target_open_factor_id"), F.col("loading").alias("lt"))
    joined = programs.join(F.broadcast(s), ["relation_id", "source_factor_id"]).join(F.broadcast(t), ["relation_id", "target_open_factor_id"])
    return joined.select(
        "relation_id", "program_id", "source_community_id", "target_open_axis_id",
        axis_type(F.col("target_open_axis_id"), n_states).alias("target_open_axis_type"),
        (F.col("core_weight") * F.col("ls") * F.col("lt")).alias("program_component_contribution"),
    )


def program_scores(programs: DataFrame, patient: DataFrame) -> DataFrame:
    """Patient loading times program weight."""
    p = programs.select("relation_id", "program_id", F.col("patient_factor_id").alias("factor_id"), "core_weight")
    return patient.join(F.broadcast(p), ["relation_id", "factor_id"]).select(
        "relation_id", "patient_id", "program_id", (F.col("loading") * F.col("core_weight")).alias("program_component_score")
    )


def rank_curve(diagnostics: DataFrame) -> DataFrame:
    """Usable restarts with a rank label, and the smallest error of each label."""
    ok = diagnostics.where("status = 'ok'").withColumn("rank_label", F.concat_ws("/", "rank_patient", "rank_source", "rank_target_open"))
    best = ok.groupBy("relation_id", "rank_label").agg(F.min("relative_error").alias("selected_error"))
    return ok.join(F.broadcast(best), ["relation_id", "rank_label"]).select(*RESTART, "rank_label", "relative_error", "selected_error")


def subset(df: DataFrame, **wanted: list) -> DataFrame:
    """Rows whose named columns hold one of the wanted values."""
    for column, values in wanted.items():
        df = df.where(F.col(column).isin(values))
    return df


def program_rows(scores: DataFrame, groups: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Scores as test rows for the group association."""
    named = comparisons.select("comparison_id", F.size("groups").alias("n_groups"), F.posexplode("groups").alias("place", "group_id"))
    joined = scores.withColumnRenamed("program_component_score", "value").join(groups.select("patient_id", "group_id"), "patient_id")
    return joined.join(F.broadcast(named), "group_id")
