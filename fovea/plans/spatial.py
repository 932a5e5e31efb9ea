"""Catalog: spatial neighbourhoods and shared states."""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import compose, neighbors, quality, states
from fovea.plans import base
from fovea.plans.base import K, SUBTYPES
from fovea.plans.catalog import query, view
from fovea.plans.statistics import _draw_sql
from fovea.runtime import staged
from fovea.schema import FOV_KEYS
from fovea.sources import binding

NN = 5
_KEYS = "patient_id, timepoint, fov_id"

view(
    "knn",
    f"""SELECT {_KEYS}, cell_id, CAST(rank AS INT) AS rank, neighbor_id, neighbor_type, dist2, n_fov FROM
        (SELECT a.patient_id, a.timepoint, a.fov_id, a.cell_id, b.cell_id AS neighbor_id, b.cell_subtype_label AS neighbor_type, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS dist2, f.n_cells AS n_fov,
           row_number() OVER (PARTITION BY a.cell_id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.cell_id) AS rank
         FROM cells a JOIN cells b ON a.patient_id = b.patient_id AND a.timepoint = b.timepoint AND a.fov_id = b.fov_id AND a.cell_id <> b.cell_id
         JOIN fovs f ON f.patient_id = a.patient_id AND f.timepoint = a.timepoint AND f.fov_id = a.fov_id) WHERE rank <= {NN}""",
    "cells", "fovs",
)


@query("nearest_neighbors", "C1", f"SELECT {_KEYS}, cell_id, rank, neighbor_id, sqrt(dist2) AS distance FROM knn", "knn", "distance")
def _(spark, sf):
    return neighbors.nearest_neighbors(base.cells(spark, sf), NN, "shrink")


view(
    "mix",
    f"""SELECT {', '.join('c.' + k for k in _KEYS.split(', '))}, c.cell_id, t.cell_subtype_label AS subtype, coalesce(count(*) FILTER (neighbor_type = t.cell_subtype_label) / nullif(count(k.rank), 0), 0) AS fraction
        FROM cells c CROSS JOIN subtypes t LEFT JOIN knn k USING (cell_id) GROUP BY ALL""",
    "cells", "knn", "subtypes",
)

# The same on whole patients: FOVs of many hundred cells, none below k + 1.
view("wide_cells", "SELECT * REPLACE ('all' AS fov_id) FROM cells", "cells")
view(
    "wide_knn",
    f"""SELECT {_KEYS}, cell_id, CAST(rank AS INT) AS rank, near.id AS neighbor_id, near.t AS neighbor_type, near.d AS dist2 FROM
        (SELECT {_KEYS}, cell_id, unnest(range(1, {NN + 1})) AS rank, unnest(nearest) AS near FROM
         (SELECT a.patient_id, a.timepoint, a.fov_id, a.cell_id, min({{'d': (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), 'id': b.cell_id, 't': b.cell_subtype_label}}, {NN}) AS nearest
          FROM wide_cells a JOIN wide_cells b ON a.patient_id = b.patient_id AND a.timepoint = b.timepoint AND a.cell_id <> b.cell_id GROUP BY 1, 2, 3, 4))""",
    "wide_cells",
)


def wide_cells(spark, sf):
    return base.cells(spark, sf).withColumn("fov_id", F.lit("all"))


@query("wide_nearest_neighbors", "C1", f"SELECT {_KEYS}, cell_id, rank, neighbor_id, sqrt(dist2) AS distance FROM wide_knn", "wide_knn", "distance")
def _(spark, sf):
    return neighbors.nearest_neighbors(wide_cells(spark, sf), NN)


@query(
    "wide_neighborhood_mix", "C2",
    f"SELECT {_KEYS}, cell_id, t.cell_subtype_label AS subtype, count(*) FILTER (neighbor_type = t.cell_subtype_label) / {NN} AS fraction FROM wide_knn CROSS JOIN subtypes t GROUP BY ALL",
    "wide_knn subtypes", "fraction",
)
def _(spark, sf):
    return neighbors.neighborhood_mix(wide_cells(spark, sf), NN, SUBTYPES)


@query("neighborhood_mix", "C2", "SELECT * FROM mix", "mix", "fraction")
def _(spark, sf):
    return neighbors.neighborhood_mix(base.cells(spark, sf), NN, SUBTYPES, "shrink")


@query(
    "shrunken_neighborhood_mix", "C3",
    f"""SELECT {', '.join('c.' + k for k in _KEYS.split(', '))}, c.cell_id, t.cell_subtype_label AS subtype, coalesce(count(*) FILTER (neighbor_type = t.cell_subtype_label) / nullif(count(k.rank), 0), 0) AS fraction
        FROM cells c CROSS JOIN subtypes t LEFT JOIN knn k USING (cell_id) GROUP BY ALL""",
    "cells knn subtypes", "fraction",
)
def _(spark, sf):
    return neighbors.neighborhood_mix(base.cells(spark, sf), NN, SUBTYPES, on_small_fov="shrink")


@query("fov_mean_features", "C4", f"SELECT {_KEYS}, subtype, avg(fraction) AS fraction FROM mix GROUP BY ALL", "mix", "fraction")
def _(spark, sf):
    return neighbors.fov_mean_features(neighbors.neighborhood_vectors(base.cells(spark, sf), NN, SUBTYPES, "shrink"), SUBTYPES)


G = 3
view(
    "gblocks",
    f"""SELECT {_KEYS}, cell_id, CAST(least(floor((y - y0) / CASE WHEN y1 > y0 THEN y1 - y0 ELSE 1 END * {G}), {G - 1}) AS INT) AS block_row, CAST(least(floor((x - x0) / CASE WHEN x1 > x0 THEN x1 - x0 ELSE 1 END * {G}), {G - 1}) AS INT) AS block_col
        FROM cells JOIN (SELECT {_KEYS}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1, 2, 3) USING ({_KEYS})""",
    "cells",
)


@query("grid_blocks", "C5", "SELECT * FROM gblocks", "gblocks")
def _(spark, sf):
    return neighbors.grid_blocks(base.cells(spark, sf), G)


B = 4
view(
    "gdrawn",
    f"""SELECT {_KEYS}, replicate, b.block_row, b.block_col, count(*) AS n_drawn, any_value(b.n) AS n_cells FROM
        (SELECT {_KEYS}, CAST(r.range AS INT) AS replicate, bs[{_draw_sql('42', "concat_ws('|', patient_id, timepoint, fov_id)", 'r.range', 's.range')} % len(bs) + 1] AS b FROM
          (SELECT {_KEYS}, list({{'block_row': block_row, 'block_col': block_col, 'n': n}} ORDER BY block_row, block_col) AS bs FROM (SELECT {_KEYS}, block_row, block_col, count(*) AS n FROM gblocks GROUP BY ALL) GROUP BY ALL),
          range({B}) r, range(1, {G * G + 1}) s WHERE s.range <= len(bs)) GROUP BY ALL""",
    "gblocks",
)


@query("block_bootstrap", "C6", "SELECT * FROM gdrawn", "gdrawn")
def _(spark, sf):
    return neighbors.block_bootstrap(neighbors.grid_blocks(base.cells(spark, sf), G), G, B, "42")


@query("block_replicate_cells", "C6", f"SELECT {_KEYS}, replicate, count(*) AS n_distinct, CAST(sum(n_drawn) AS BIGINT) AS n_total FROM gblocks JOIN gdrawn USING ({_KEYS}, block_row, block_col) GROUP BY ALL", "gblocks gdrawn")
def _(spark, sf):
    blocks = neighbors.grid_blocks(base.cells(spark, sf), G)
    cells = neighbors.replicate_cells(neighbors.block_bootstrap(blocks, G, B, "42"), blocks)
    return cells.groupBy(*FOV_KEYS, "replicate").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n_drawn").alias("n_total"))


# --- states ------------------------------------------------------------------


def feature_counts(spark, sf):
    """Different neighbourhood vectors with their number of cells; few, as k neighbours give few shares."""
    build = lambda: states.row_counts(neighbors.neighborhood_vectors(base.cells(spark, sf), NN, SUBTYPES, "shrink"))
    return staged(spark, "feature_counts", sf, build)


@query("fit_states", "D1")
def _(spark, sf):
    vectors = feature_counts(spark, sf)
    centroids, cost = states.fit_states(vectors, K)
    return centroids.select("state_id", F.to_json("features").alias("centroid"), F.lit(cost).alias("training_cost"))


@query(
    "fitted_state_checks", "D1 D2",
    f"SELECT CAST(range AS INT) AS state_id, {len(SUBTYPES)} AS n_features, true AS is_mean_of_its_cells, true AS cost_adds_up FROM range({K})",
)
def _(spark, sf):
    """Each centroid is the mean of the cells nearest to it, and the distances add up to the training cost."""
    vectors = feature_counts(spark, sf)
    centroids, cost = states.fit_states(vectors, K, n_starts=5)
    near = states.assign_states(vectors, centroids)
    means = near.groupBy("state_id").agg(
        F.array(*[F.sum(F.col("weight") * F.get("features", F.lit(i))) / F.sum("weight") for i in range(len(SUBTYPES))]).alias("mean"),
        F.sum(F.col("weight") * F.col("distance2")).alias("d2"),
    )
    total = means.agg(F.sum("d2").alias("total"))
    off = F.sqrt(states.squared_distance(F.col("features"), F.col("mean")))
    return centroids.join(means, "state_id").crossJoin(F.broadcast(total)).select(
        "state_id", F.size("features").alias("n_features"), (off < 0.05).alias("is_mean_of_its_cells"), (F.abs(F.col("total") - cost) <= 1e-6 * cost).alias("cost_adds_up")
    )


# Centroids from the labels of the embeddings: their mean vectors.
view("label_dim", "SELECT label AS state_id, i, avg(v) AS c FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")
view("emb_dim", "SELECT CAST(vec_id AS VARCHAR) AS cell_id, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
view("ecost", "SELECT a.state_id AS i, b.state_id AS j, sqrt(sum((a.c - b.c) ** 2)) AS cost FROM label_dim a JOIN label_dim b ON a.i = b.i GROUP BY 1, 2", "label_dim")


def label_centroids(spark, sf):
    e = binding.embeddings(spark, sf)
    return staged(
        spark, "label_centroids", sf,
        lambda: e.groupBy(F.col("label").alias("state_id")).agg(F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(64)]).alias("features")),
    )


@query(
    "assign_states", "D2",
    """SELECT cell_id, state_id, distance2 FROM (SELECT cell_id, state_id, distance2, row_number() OVER (PARTITION BY cell_id ORDER BY distance2, state_id) AS rn FROM
       (SELECT cell_id, state_id, sum((v - c) ** 2) AS distance2 FROM emb_dim JOIN label_dim USING (i) GROUP BY 1, 2)) WHERE rn = 1""",
    "emb_dim label_dim", "distance2",
)
def _(spark, sf):
    return states.assign_states(binding.embeddings(spark, sf), label_centroids(spark, sf)).select("cell_id", "state_id", "distance2")


@query(
    "weighted_state_burden", "D3",
    """SELECT patient_id, domain_label, s.state_id, coalesce(b, 0) AS burden, total, CASE WHEN total > 0 THEN coalesce(b, 0) / total ELSE 0 END AS fraction FROM
       (SELECT patient_id, domain_label, sum(x) AS total FROM cells GROUP BY 1, 2) CROSS JOIN states s LEFT JOIN (SELECT patient_id, domain_label, state_id, sum(x) AS b FROM cells GROUP BY 1, 2, 3) USING (patient_id, domain_label, state_id)""",
    "cells states", "burden total fraction",
)
def _(spark, sf):
    return compose.weighted_burden(base.cells(spark, sf), ["patient_id", "domain_label"], K, "x")


_PAIR = "label_dim a JOIN label_dim b ON a.i = b.i GROUP BY 1, 2"
_METRIC_SQL = {
    "euclidean": "sqrt(sum((a.c - b.c) ** 2))",
    "sqeuclidean": "sum((a.c - b.c) ** 2)",
    "cityblock": "sum(abs(a.c - b.c))",
    "chebyshev": "max(abs(a.c - b.c))",
    "cosine": "CASE WHEN a.state_id = b.state_id THEN 0 ELSE 1 - sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))) END",
    "correlation": "CASE WHEN a.state_id = b.state_id THEN 0 ELSE 1 - corr(a.c, b.c) END",
}


@query(
    "state_costs", "D4",
    " UNION ALL ".join(f"SELECT a.state_id AS i, b.state_id AS j, {e} AS cost, '{m}' AS metric FROM {_PAIR}" for m, e in _METRIC_SQL.items()),
    "label_dim", "cost",
)
def _(spark, sf):
    c = label_centroids(spark, sf)
    parts = [states.state_cost(c, m).withColumn("metric", F.lit(m)) for m in _METRIC_SQL]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "cost_scale", "D5 D6",
    "SELECT median(cost) FILTER (i < j AND cost > 1e-12) AS cost_scale, count(*) FILTER (i < j AND cost <= 1e-12) AS n_coincident_pairs FROM ecost", "ecost", "cost_scale",
)
def _(spark, sf):
    return states.cost_scale(states.state_cost(label_centroids(spark, sf)))


view(
    "egraph",
    """SELECT DISTINCT i, j FROM (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY cost, j) AS r FROM ecost WHERE i <> j) WHERE r <= 3
       UNION ALL SELECT j, i FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY cost, j) AS r FROM ecost WHERE i <> j) WHERE r <= 3 UNION ALL SELECT i, i FROM ecost)""",
    "ecost",
)


@query("similarity_graph", "D7", "SELECT * FROM egraph", "egraph")
def _(spark, sf):
    return states.similarity_graph(states.state_cost(label_centroids(spark, sf)), 3)


@query("graph_similarity", "D8", "SELECT i, j, exp(-cost / (SELECT median(cost) FROM ecost WHERE i < j AND cost > 1e-12)) AS similarity FROM ecost JOIN egraph USING (i, j)", "ecost egraph", "similarity")
def _(spark, sf):
    cost = states.state_cost(label_centroids(spark, sf))
    return states.graph_similarity(cost, states.similarity_graph(cost, 3), states.cost_scale(cost))


@query(
    "bad_features", "B20",
    f"SELECT cell_id, count(*) FILTER (fraction < 0) AS n_bad, count(*) AS n_labels, sum(fraction) AS total FROM (SELECT cell_id, CASE WHEN fraction = 1 THEN -fraction ELSE fraction END AS fraction FROM mix WHERE NOT (subtype = 'SMALL' AND fraction = 0.8)) GROUP BY 1 HAVING count(*) <> 6 OR count(*) FILTER (fraction < 0) > 0 OR abs(sum(fraction) - 1) > 1e-8",
    "mix", "total",
)
def _(spark, sf):
    mix = neighbors.neighborhood_mix(base.cells(spark, sf), NN, SUBTYPES, "shrink")
    flawed = mix.where(~((F.col("subtype") == "SMALL") & (F.col("fraction") == 0.8))).withColumn(
        "fraction", F.when(F.col("fraction") == 1, -F.col("fraction")).otherwise(F.col("fraction"))
    )
    return quality.bad_features(flawed, len(SUBTYPES))


@query(
    "basis_problems", "B20",
    "SELECT 'state_without_centroid' AS problem, count(*) AS n FROM cells WHERE state_id NOT IN (SELECT label FROM embeddings WHERE label <> 3) GROUP BY state_id UNION ALL SELECT 'wrong_count', 4", "cells",
)
def _(spark, sf):
    return quality.basis_problems(base.cells(spark, sf), label_centroids(spark, sf).where("state_id <> 3"), K, 64)
