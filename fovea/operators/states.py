"""Shared states: clustering, assignment, pairwise cost and similarity graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.runtime import literal_table, write_stage
from fovea.schema import MASS_TOL


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


#: Different rows that the starts are drawn from, those with the smallest hashes; a bound for the driver.
SEED_ROWS = 4096
#: A start is settled when none of its centres moves further.
SHIFT_TOL, MAX_ITER = 1e-4, 50
_BATCH = 4096


def seed_centers(rows: np.ndarray, n_states: int, n_starts: int, seed: int, weight: np.ndarray | None = None) -> np.ndarray:
    """[starts, states, features]: each next centre by its weight and squared distance to the ones before."""
    out = np.empty((n_starts, n_states, rows.shape[1]))
    weight = np.ones(len(rows)) if weight is None else weight
    for start in range(n_starts):
        rng = np.random.default_rng([seed, start])
        out[start, 0] = rows[rng.choice(len(rows), p=weight / weight.sum())]
        near = ((rows - out[start, 0]) ** 2).sum(1)
        for k in range(1, n_states):
            total = (weight * near).sum()
            out[start, k] = rows[rng.choice(len(rows), p=weight * near / total) if total > 0 else rng.integers(len(rows))]
            near = np.minimum(near, ((rows - out[start, k]) ** 2).sum(1))
    return out


def lloyd_sums(vectors: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, squared distances) of the rows nearest to every centre of every start, in one job.

    A column ``weight`` says for how many equal rows a row stands.
    """
    starts, k, d = centers.shape
    weighted = "weight" in vectors.columns
    vectors = vectors.select("features", *(["weight"] if weighted else []))
    width = k * (d + 1) + 1

    def run(batches):
        total = np.zeros((starts, width))
        offset = 0.5 * (centers**2).sum(2)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            weight = batch.column(1).to_numpy(zero_copy_only=False) if weighted else np.ones(len(flat))
            for lo in range(0, len(flat), _BATCH):
                x, w = flat[lo : lo + _BATCH], weight[lo : lo + _BATCH]
                for s in range(starts):
                    own = np.argmin(offset[s] - x @ centers[s].T, 1)
                    for j in range(d):
                        total[s, j * k : (j + 1) * k] += np.bincount(own, w * x[:, j], k)
                    total[s, d * k : -1] += np.bincount(own, w, k)
                    total[s, -1] += w @ ((x - centers[s, own]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["slot", "value"])

    got = vectors.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(starts * width)
    total[got["slot"].to_numpy()] = got["value"].to_numpy()
    total = total.reshape(starts, width)
    return total[:, : d * k].reshape(starts, d, k).transpose(0, 2, 1), total[:, d * k : -1], total[:, -1]


def row_counts(features: DataFrame) -> DataFrame:
    """Different rows with their number, or with the sum of ``weight`` where the rows have one."""
    weight = F.sum("weight") if "weight" in features.columns else F.count(F.lit(1)).cast("double")
    return features.groupBy("features").agg(weight.alias("weight"))


def fit_states(features: DataFrame, n_states: int, n_starts: int = 20, seed: int = 42, max_iter: int = MAX_ITER) -> tuple[DataFrame, float]:
    """Best of several k-means starts; centroids relabelled in lexicographic order.

    Equal rows are counted first and travel as one with their ``weight`` (a column of
    ``features`` may give it already, see :func:`row_counts`). All starts move together: a job per iteration adds up the rows of every centre of every
    start that still moves, over a written stage. Returns the centroids (state-sized) and
    the training cost of the best start. A centre that loses all rows stays where it was.
    """
    vectors = write_stage(row_counts(features), "vectors")
    drawn = vectors.orderBy(F.xxhash64("features", F.lit(seed)), "features").limit(SEED_ROWS).collect()
    if not drawn:
        raise ValueError("there are no rows to cluster")
    centers = seed_centers(np.array([r["features"] for r in drawn], float), n_states, n_starts, seed, np.array([r["weight"] for r in drawn]))
    cost, live = np.full(n_starts, np.inf), np.ones(n_starts, bool)
    for _ in range(max_iter):
        sums, counts, _ = lloyd_sums(vectors, centers[live])
        new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centers[live])
        moved = ((new - centers[live]) ** 2).sum(2).max(1) > SHIFT_TOL**2
        centers[live] = new
        live[np.flatnonzero(live)[~moved]] = False
        if not live.any():
            break
    _, _, cost = lloyd_sums(vectors, centers)
    best = int(np.argmin(cost))
    rows = list(enumerate(sorted([float(v) for v in c] for c in centers[best])))
    return literal_table(features.sparkSession, ["state_id", "features"], rows), float(cost[best])


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))


def assign_states(features: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid of every row, ties to the lowest id.

    The centroids are state-sized: they travel as one array column, so each row
    finds its minimum without a join that multiplies rows.
    """
    listed = [(int(r["state_id"]), [float(v) for v in r["features"]]) for r in centroids.collect()]
    options = F.array(
        *[
            F.struct(
                squared_distance(F.col("features"), F.array(*[F.lit(v) for v in center])).alias("d2"),
                F.lit(state).alias("state_id"),
            )
            for state, center in sorted(listed)
        ]
    )
    nearest = F.array_min(options)
    return features.withColumn("nearest", nearest).select(
        *features.columns, F.col("nearest.state_id").alias("state_id"), F.col("nearest.d2").alias("distance2")
    )


def _mean(v: Column) -> Column:
    return _sum(v) / F.size(v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda u, v: u * v))


def _cosine(a: Column, b: Column) -> Column:
    scale = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.lit(1.0) - _dot(a, b) / F.when(scale > 0, scale)


def _centred(v: Column) -> Column:
    return F.zip_with(v, F.array_repeat(_mean(v), F.size(v)), lambda u, m: u - m)


METRICS = {
    "euclidean": lambda a, b: F.sqrt(squared_distance(a, b)),
    "sqeuclidean": squared_distance,
    "cityblock": lambda a, b: _sum(F.zip_with(a, b, lambda u, v: F.abs(u - v))),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u - v))),
    "cosine": _cosine,
    "correlation": lambda a, b: _cosine(_centred(a), _centred(b)),
}


def state_pairs(vectors: DataFrame, column: str) -> DataFrame:
    """All ordered state pairs (state-sized) with both vectors."""
    listed = vectors.agg(F.array_sort(F.collect_list(F.struct("state_id", F.col(column).alias("v")))).alias("all"))
    pairs = listed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    return pairs.select(
        F.col("a.state_id").alias("i"), F.col("b.state_id").alias("j"), F.col("a.v").alias("u"), F.col("b.v").alias("v")
    )


def state_cost(centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    pairs = state_pairs(centroids, "features")
    cost = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(METRICS[metric](F.col("u"), F.col("v")))
    return pairs.select("i", "j", cost.alias("cost"))


def cost_scale(cost: DataFrame) -> DataFrame:
    """Median of the positive upper-triangle costs, and coincident distinct pairs."""
    upper = F.col("i") < F.col("j")
    return cost.agg(
        F.median(F.when(upper & (F.col("cost") > MASS_TOL), F.col("cost"))).alias("cost_scale"),
        F.count_if(upper & (F.col("cost") <= MASS_TOL)).alias("n_coincident_pairs"),
    )


def similarity_graph(cost: DataFrame, n_neighbors: int = 5) -> DataFrame:
    """Symmetric nearest-state graph with a unit diagonal (state-sized)."""
    near = Window.partitionBy("i").orderBy("cost", "j")
    edges = cost.where("i <> j").withColumn("r", F.row_number().over(near)).where(F.col("r") <= n_neighbors).select("i", "j")
    both = edges.union(edges.select("j", "i")).union(cost.where("i = j").select("i", "j"))
    return both.distinct()


def graph_similarity(cost: DataFrame, graph: DataFrame, scale: DataFrame) -> DataFrame:
    """``exp(-cost/scale)`` on the graph edges."""
    scaled = cost.join(graph, ["i", "j"], "left_semi").withColumn("one", F.lit(1))
    return scaled.join(scale.select("cost_scale").withColumn("one", F.lit(1)), "one").select(
        "i", "j", F.exp(-F.col("cost") / F.col("cost_scale")).alias("similarity")
    )


def identity_vectors(mix: DataFrame, category: str) -> DataFrame:
    """Category fractions of each state as one array, in category order."""
    ordered = F.array_sort(F.collect_list(F.struct(category, "fraction")))
    return mix.groupBy("state_id").agg(F.transform(ordered, lambda s: s["fraction"]).alias("identity"))


def js_divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence of two probability arrays."""

    def half(p: Column, q: Column) -> Column:
        return _sum(F.zip_with(p, q, lambda u, v: F.when(u > 0, u * F.log(u / ((u + v) / 2))).otherwise(0.0)))

    return half(a, b) / 2 + half(b, a) / 2


def identity_cost(identities: DataFrame) -> DataFrame:
    """Root Jensen-Shannon cost between states and its median-normalised form."""
    pairs = state_pairs(identities, "identity").select(
        "i", "j", F.sqrt(F.greatest(js_divergence(F.col("u"), F.col("v")), F.lit(0.0))).alias("cost_raw")
    )
    whole = Window.partitionBy(F.lit(0))
    positive = F.median(F.when(F.col("cost_raw") > 0, F.col("cost_raw"))).over(whole)
    return pairs.withColumn("cost_scale", F.coalesce(positive, F.lit(1.0))).withColumn(
        "cost", F.col("cost_raw") / F.col("cost_scale")
    )
