"""Catalog: pairing, states, closed-form relations and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fovea.operators import compose, estimate, pairing, quality, states, summary
from fovea.plans import base
from fovea.plans.base import DOMAINS, K, LEFT, SUBTYPES
from fovea.plans.catalog import query, view
from fovea.runtime import scratch_path, staged
from fovea.schema import FOV_KEYS, COORD, REL_PATIENT
from fovea.sources import binding, load, sinks

RK = ["relation_id", "patient_id"]
N_PERM, SEED = 199, 17
TAU = 2.0

# --- pairing ---------------------------------------------------------------

view("rel_fovs", "SELECT s.relation_id, f.patient_id, s.side, f.timepoint, f.domain_label, f.fov_id FROM fovs f JOIN sides s USING (timepoint, domain_label)", "fovs", "sides")
view(
    "support",
    """SELECT *, CASE WHEN n_source > 0 AND n_target > 0 THEN 'eligible' WHEN n_source > 0 THEN 'missing_target' ELSE 'missing_source' END AS status
       FROM (SELECT relation_id, patient_id, count(*) FILTER (side = 'source') AS n_source, count(*) FILTER (side = 'target') AS n_target FROM rel_fovs GROUP BY 1, 2)""",
    "rel_fovs",
)
view("bags", "SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY relation_id, patient_id, side) AS n_side FROM rel_fovs WINDOW w AS (PARTITION BY relation_id, patient_id, side ORDER BY fov_id, domain_label)", "rel_fovs")
view(
    "blocks",
    """SELECT relation_id, patient_id, CAST(CASE WHEN p0 < h THEN p0 // (b + 1) ELSE x + (p0 - h) // b END AS INT) AS subbag_index, side, fov_id, timepoint, domain_label FROM
       (SELECT *, n_side // np AS b, n_side % np AS x, (n_side % np) * (n_side // np + 1) AS h, position - 1 AS p0 FROM bags
        JOIN (SELECT relation_id, patient_id, least(n_source, n_target) AS np FROM support WHERE status = 'eligible') USING (relation_id, patient_id))""",
    "bags", "support",
)


def rel_fovs(spark, sf):
    return pairing.relation_fovs(base.fovs(spark, sf), base.sides(spark))


def support(spark, sf):
    return staged(spark, "support", sf, lambda: pairing.relation_support(rel_fovs(spark, sf)))


def blocks(spark, sf):
    return staged(
        spark, "blocks", sf, lambda: pairing.evidence_blocks(pairing.ordered_bags(rel_fovs(spark, sf)), support(spark, sf))
    )


@query("relation_fovs", "F1", "SELECT * FROM rel_fovs", "rel_fovs")
def _(spark, sf):
    return rel_fovs(spark, sf)


@query("relation_support", "F2", "SELECT * FROM support", "support")
def _(spark, sf):
    return support(spark, sf)


@query(
    "relation_report", "F3",
    """SELECT r.relation_index, r.relation_id, count(*) FILTER (status = 'eligible') AS n_eligible_patients, count(*) FILTER (status <> 'eligible') AS n_skipped_patients,
       CAST(coalesce(sum(n_source), 0) AS BIGINT) AS n_source_rows, CAST(coalesce(sum(n_target), 0) AS BIGINT) AS n_target_rows,
       CASE WHEN count(*) FILTER (status = 'eligible') > 0 THEN 'fit' ELSE 'no_eligible_patients' END AS relation_status
       FROM (SELECT relation_index, relation_id FROM relations UNION ALL SELECT 3, 'post_X_to_pre_Y') r LEFT JOIN support USING (relation_id) GROUP BY 1, 2""",
    "relations support",
)
def _(spark, sf):
    extra = spark.sql("SELECT 3 AS relation_index, 'post_X_to_pre_Y' AS relation_id")
    declared = base.relations(spark).select("relation_index", "relation_id").union(extra)
    return pairing.relation_report(declared, support(spark, sf))


@query("ordered_bags", "F4", "SELECT * FROM bags", "bags")
def _(spark, sf):
    return pairing.ordered_bags(rel_fovs(spark, sf))


@query(
    "balanced_parts", "F5",
    "SELECT relation_id, patient_id, side, subbag_index, count(*) AS n_fovs, min(fov_id) AS first_fov FROM blocks GROUP BY 1, 2, 3, 4", "blocks",
)
def _(spark, sf):
    return blocks(spark, sf).groupBy(*RK, "side", "subbag_index").agg(F.count(F.lit(1)).alias("n_fovs"), F.min("fov_id").alias("first_fov"))


@query("evidence_blocks", "F6", "SELECT *, patient_id || ':subbag_' || subbag_index AS block_id FROM blocks", "blocks")
def _(spark, sf):
    return pairing.with_block_id(blocks(spark, sf))


@query(
    "bag_pair_summary", "F7",
    """SELECT a.relation_id, a.patient_id, a.state_id, count(*) AS n_pairs, avg(a.fraction + b.fraction) AS mean_combined, avg(a.fraction * b.fraction) AS mean_product
       FROM (SELECT * FROM comp JOIN sides USING (timepoint, domain_label) WHERE side = 'source') a
       JOIN (SELECT * FROM comp JOIN sides USING (timepoint, domain_label) WHERE side = 'target') b USING (relation_id, patient_id, state_id) GROUP BY 1, 2, 3""",
    "comp sides", "mean_combined mean_product",
)
def _(spark, sf):
    return pairing.bag_pair_summary(base.composition(spark, sf), base.sides(spark))


@query(
    "patient_inputs", "F8",
    "SELECT patient_id, count(*) AS n_observations, count(*) FILTER (timepoint = 'pre') AS n_pre, count(*) FILTER (timepoint = 'post') AS n_post, "
    + ", ".join(f"count(*) FILTER (domain_label = '{d}') AS \"n_{d}\"" for d in DOMAINS)
    + ", any_value(group_id) AS group_id FROM fovs LEFT JOIN grps USING (patient_id) GROUP BY 1",
    "fovs grps",
)
def _(spark, sf):
    return pairing.patient_inputs(base.fovs(spark, sf), base.groups(spark, sf), DOMAINS)


# Labels are shuffled inside the ordered pair BUILDING / MACHINERY, with the
# domain as the ordered side.
SRC, TGT = "BUILDING", "MACHINERY"
view("family_fovs", "SELECT DISTINCT patient_id, timepoint, fov_id, domain_label FROM family_cells", "family_cells")
view(
    "perms",
    f"""SELECT permutation_index, patient_id, timepoint, fov_id, original_domain_label,
          CASE WHEN place <= n_src THEN '{SRC}' ELSE '{TGT}' END AS permuted_domain_label, seed FROM (
        SELECT *, row_number() OVER (PARTITION BY permutation_index, patient_id ORDER BY sha256(concat_ws('|', seed, timepoint, fov_id))) AS place,
          count(*) FILTER (original_domain_label = '{SRC}') OVER (PARTITION BY permutation_index, patient_id) AS n_src FROM
        (SELECT CAST(p.range AS INT) AS permutation_index, patient_id, timepoint, fov_id, domain_label AS original_domain_label,
           substr(sha256('within_patient_domain_labels|{SEED}|' || patient_id || '|' || p.range), 1, 8) AS seed FROM family_fovs CROSS JOIN range({N_PERM}) p))""",
    "family_fovs",
)


def family_fovs(spark, sf):
    """FOVs of the ordered pair, of patients seen on both sides; read from the staged FOV table."""
    c = base.fov_table(spark, sf)
    return c.where(F.col("domain_label").isin(SRC, TGT)).join(compose.family_patients(c, SRC, TGT), "patient_id", "left_semi")


def family_vectors(spark, sf):
    """One composition array per family FOV, under its full key and domain."""
    return compose.vectors_of(family_fovs(spark, sf))


def permutations(spark, sf, n=N_PERM):
    return pairing.permuted_labels(family_fovs(spark, sf).select(*FOV_KEYS, "domain_label"), n, SEED)


@query("permuted_labels", "F9", "SELECT * FROM perms", "perms")
def _(spark, sf):
    return permutations(spark, sf)


view(
    "family_comp",
    """SELECT f.patient_id, f.timepoint, f.domain_label, f.fov_id, s.state_id, count(c.cell_id) / any_value(f.n) AS fraction
       FROM (SELECT patient_id, timepoint, domain_label, fov_id, count(*) AS n FROM family_cells GROUP BY 1, 2, 3, 4) f CROSS JOIN states s
       LEFT JOIN family_cells c USING (patient_id, timepoint, domain_label, fov_id, state_id) GROUP BY 1, 2, 3, 4, 5""",
    "family_cells", "states",
)
view(
    "perm_endpoints",
    f"""SELECT permutation_index, patient_id, state_id, avg(fraction) FILTER (permuted_domain_label = '{SRC}') AS x, avg(fraction) FILTER (permuted_domain_label = '{TGT}') AS y
       FROM perms JOIN family_comp USING (patient_id, timepoint, fov_id) GROUP BY 1, 2, 3""",
    "perms", "family_comp",
)


def null_endpoints(spark, sf, n=N_PERM):
    build = lambda: pairing.labelled_endpoints(pairing.permuted_labels(family_vectors(spark, sf), n, SEED, ("fractions",)), SRC, TGT, K)
    return staged(spark, f"null_endpoints_{n}", sf, build)


def real_endpoints(spark, sf):
    """Observed endpoints of the family, in the shape of one permutation."""
    vec = family_vectors(spark, sf)
    labels = vec.select(*FOV_KEYS, F.lit(-1).alias("permutation_index"), F.col("domain_label").alias("permuted_domain_label"))
    return staged(spark, "real_endpoints", sf, lambda: pairing.permuted_endpoints(vec, labels, SRC, TGT, K))


@query("permuted_endpoints", "F10", "SELECT * FROM perm_endpoints", "perm_endpoints", "x y")
def _(spark, sf):
    return estimate.endpoints_long(null_endpoints(spark, sf))


N_TEST, N_RERUN = 8, 5
view("patients", "SELECT DISTINCT patient_id FROM cells", "cells")
view(
    "splits",
    f"""SELECT CAST(r.range AS INT) AS rerun_index, patient_id, CASE WHEN row_number() OVER (PARTITION BY r.range ORDER BY sha256('{SEED}|' || r.range || '|' || patient_id)) <= {N_TEST}
        THEN 'test' ELSE 'train' END AS split FROM patients CROSS JOIN range({N_RERUN}) r""",
    "patients",
)


def splits(spark, sf):
    patients = base.cells(spark, sf).select("patient_id").distinct()
    return staged(spark, "splits", sf, lambda: pairing.patient_splits(patients, N_TEST, N_RERUN, SEED))


@query("patient_splits", "F11", "SELECT * FROM splits", "splits")
def _(spark, sf):
    return splits(spark, sf)


_ORDER = [str(24 - i) for i in range(25)]


@query("requested_patients", "F12", "SELECT f.patient_id, 24 - CAST(f.patient_id AS INT) AS patient_order, f.timepoint, f.fov_id FROM fovs f", "fovs")
def _(spark, sf):
    return pairing.requested_patients(base.fovs(spark, sf).select("patient_id", "timepoint", "fov_id"), _ORDER)


# --- states ----------------------------------------------------------------

view(
    "idvec",
    "SELECT state_id, cell_subtype_label, n / sum(n) OVER (PARTITION BY state_id) AS g FROM (SELECT state_id, t.cell_subtype_label, count(c.cell_id) AS n FROM states CROSS JOIN subtypes t LEFT JOIN cells c USING (state_id, cell_subtype_label) GROUP BY 1, 2)",
    "states", "subtypes", "cells",
)
view(
    "idraw",
    """SELECT a.state_id AS i, b.state_id AS j, sqrt(greatest(0.0, sum(CASE WHEN a.g > 0 THEN a.g * ln(a.g / ((a.g + b.g) / 2)) ELSE 0 END) / 2
       + sum(CASE WHEN b.g > 0 THEN b.g * ln(b.g / ((a.g + b.g) / 2)) ELSE 0 END) / 2)) AS cost_raw
       FROM idvec a JOIN idvec b USING (cell_subtype_label) GROUP BY 1, 2""",
    "idvec",
)
view("idcost", "SELECT i, j, cost_raw, (SELECT median(cost_raw) FROM idraw WHERE cost_raw > 0) AS cost_scale, cost_raw / (SELECT median(cost_raw) FROM idraw WHERE cost_raw > 0) AS cost FROM idraw", "idraw")


def identity(spark, sf):
    return states.identity_vectors(compose.category_mix(base.cells(spark, sf), "cell_subtype_label", SUBTYPES, K), "cell_subtype_label")


def identity_cost(spark, sf):
    return staged(spark, "identity_cost", sf, lambda: states.identity_cost(identity(spark, sf)))


@query("identity_vectors", "D9", "SELECT state_id, cell_subtype_label, g FROM idvec", "idvec", "g")
def _(spark, sf):
    v = identity(spark, sf)
    names = F.array(*[F.lit(s) for s in SUBTYPES])
    return v.select("state_id", F.inline(F.arrays_zip(names.alias("cell_subtype_label"), F.col("identity").alias("g")))).toDF("state_id", "cell_subtype_label", "g")


@query("identity_cost", "D10", "SELECT * FROM idcost", "idcost", "cost_raw cost_scale cost")
def _(spark, sf):
    return identity_cost(spark, sf)


# --- closed-form relations ---------------------------------------------------

_TOLX = "1e-12"
view(
    "diag",
    f"""SELECT e.relation_id, e.patient_id, 'A' AS entry_type, e.state_id AS row_id, s.state_id AS col_id, CASE WHEN e.x > {_TOLX} AND e.state_id = s.state_id THEN least(x, y) / x ELSE 0 END AS value FROM endpoints e CROSS JOIN states s
        UNION ALL SELECT relation_id, patient_id, 'd', state_id, {K}, CASE WHEN x > {_TOLX} THEN greatest((x - least(x, y)) / x, 0) ELSE 0 END FROM endpoints
        UNION ALL SELECT relation_id, patient_id, 'e', {K}, state_id, greatest(y - least(x, y), 0) FROM endpoints""",
    "endpoints", "states",
)


def gated_views(prefix: str, source: str, keys: str) -> None:
    """SQL of the gated residual templates over any (keys, state_id, x, y) view."""
    k = keys
    view(f"{prefix}_gap", f"SELECT {k}, state_id, x, y, greatest(x - y, 0) AS rm, greatest(y - x, 0) AS rp, sum(greatest(x - y, 0)) OVER (PARTITION BY {k}) AS rho FROM (SELECT {k}, state_id, x / sum(x) OVER (PARTITION BY {k}) AS x, y / sum(y) OVER (PARTITION BY {k}) AS y FROM {source})", source)
    view(
        f"{prefix}_move",
        f"SELECT {k}, a.state_id AS i, b.state_id AS j, CASE WHEN a.state_id = b.state_id OR a.rho <= {_TOLX} THEN 0 ELSE exp(-c.cost / {TAU}) * a.rm * b.rp / a.rho END AS moved FROM {prefix}_gap a JOIN {prefix}_gap b USING ({k}) JOIN idcost c ON c.i = a.state_id AND c.j = b.state_id",
        f"{prefix}_gap", "idcost",
    )
    view(
        f"{prefix}_tmpl",
        f"""SELECT {k}, g.state_id, g.x, g.y, g.rho, g.x > {_TOLX} AS identified,
            CASE WHEN g.rho <= {_TOLX} OR g.x <= {_TOLX} THEN 0 ELSE greatest(g.rm - o.moved, 0) / g.x END AS d, CASE WHEN g.rho <= {_TOLX} THEN 0 ELSE greatest(g.rp - n.moved, 0) END AS e
            FROM {prefix}_gap g JOIN (SELECT {k}, i AS state_id, sum(moved) AS moved FROM {prefix}_move GROUP BY {k}, i) o USING ({k}, state_id)
            JOIN (SELECT {k}, j AS state_id, sum(moved) AS moved FROM {prefix}_move GROUP BY {k}, j) n USING ({k}, state_id)""",
        f"{prefix}_gap", f"{prefix}_move",
    )
    view(
        f"{prefix}_a",
        f"""SELECT {k}, m.i, m.j, CASE WHEN t.rho <= {_TOLX} THEN CASE WHEN m.i = m.j THEN 1 ELSE 0 END WHEN NOT t.identified THEN 0
            WHEN m.i = m.j THEN least(t.x, t.y) / t.x ELSE m.moved / t.x END AS a FROM {prefix}_move m JOIN {prefix}_tmpl t ON {' AND '.join(f'm.{c} = t.{c}' for c in k.split(', '))} AND t.state_id = m.i""".replace(f"SELECT {k}, m.i", "SELECT " + ", ".join(f"m.{c}" for c in k.split(", ")) + ", m.i"),
        f"{prefix}_move", f"{prefix}_tmpl",
    )
    view(
        f"{prefix}_raw",
        f"""SELECT {k}, 'A' AS entry_type, i AS row_id, j AS col_id, a AS value FROM {prefix}_a
            UNION ALL SELECT {k}, 'd', state_id, {K}, d FROM {prefix}_tmpl UNION ALL SELECT {k}, 'e', {K}, state_id, e FROM {prefix}_tmpl""",
        f"{prefix}_a", f"{prefix}_tmpl",
    )


gated_views("g", "endpoints", "relation_id, patient_id")
gated_views("null", "perm_endpoints", "permutation_index, patient_id")
view(
    "real_endpoints",
    f"SELECT -1 AS permutation_index, patient_id, state_id, avg(fraction) FILTER (domain_label = '{SRC}') AS x, avg(fraction) FILTER (domain_label = '{TGT}') AS y FROM family_comp GROUP BY 2, 3",
    "family_comp",
)
gated_views("real", "real_endpoints", "permutation_index, patient_id")
view(
    "pooled",
    f"""SELECT relation_id, i, j, CASE WHEN w > {_TOLX} THEN wa / w / (tot / w) ELSE CASE WHEN i = j THEN 1 ELSE 0 END END AS a, CASE WHEN w > {_TOLX} THEN wd / w / (tot / w) ELSE 0 END AS d FROM
        (SELECT *, sum(wa) OVER (PARTITION BY relation_id, i) + wd AS tot FROM
         (SELECT a.relation_id, a.i, a.j, sum(CASE WHEN t.identified THEN t.x ELSE 0 END) AS w, sum(CASE WHEN t.identified THEN t.x * a.a ELSE 0 END) AS wa, sum(CASE WHEN t.identified THEN t.x * t.d ELSE 0 END) AS wd
          FROM g_a a JOIN g_tmpl t ON a.relation_id = t.relation_id AND a.patient_id = t.patient_id AND a.i = t.state_id GROUP BY 1, 2, 3))""",
    "g_a", "g_tmpl",
)
view(
    "gated",
    f"""SELECT a.relation_id, a.patient_id, 'A' AS entry_type, a.i AS row_id, a.j AS col_id, CASE WHEN t.identified THEN a.a ELSE p.a END AS value
        FROM g_a a JOIN g_tmpl t ON a.relation_id = t.relation_id AND a.patient_id = t.patient_id AND a.i = t.state_id JOIN pooled p ON p.relation_id = a.relation_id AND p.i = a.i AND p.j = a.j
        UNION ALL SELECT t.relation_id, t.patient_id, 'd', t.state_id, {K}, CASE WHEN t.identified THEN t.d ELSE p.d END FROM g_tmpl t JOIN pooled p ON p.relation_id = t.relation_id AND p.i = t.state_id AND p.j = 0
        UNION ALL SELECT relation_id, patient_id, 'e', {K}, state_id, e FROM g_tmpl""",
    "g_a", "g_tmpl", "pooled",
)


def endpoints(spark, sf):
    vectors = lambda: base.fov_vectors(spark, sf)
    return staged(spark, "endpoints", sf, lambda: estimate.endpoint_vectors(vectors(), base.sides(spark), K))


def diagonal(spark, sf):
    return estimate.diagonal_relation(endpoints(spark, sf), K)


def templates(spark, sf):
    return staged(spark, "templates", sf, lambda: estimate.gated_templates(endpoints(spark, sf), identity_cost(spark, sf), TAU))


def gated(spark, sf):
    """Gated relations with unseen rows filled from the cohort."""
    fill = lambda: estimate.filled_templates(templates(spark, sf), ["relation_id"], K)
    return staged(spark, "gated", sf, lambda: estimate.template_entries(fill(), K))


@query("diagonal_plan", "G2", "SELECT relation_id, patient_id, state_id AS i, state_id AS j, least(x, y) AS mass FROM endpoints", "endpoints", "mass")
def _(spark, sf):
    return estimate.diagonal_plan(endpoints(spark, sf))


@query("relation_from_plan", "G3", "SELECT * FROM diag", "diag", "value")
def _(spark, sf):
    ep = endpoints(spark, sf)
    return estimate.relation_from_plan(ep, estimate.diagonal_plan(ep), K)


@query("diagonal_relation", "G2 G3", "SELECT * FROM diag", "diag", "value")
def _(spark, sf):
    return diagonal(spark, sf)


@query("gated_relation", "G4", "SELECT * FROM g_raw", "g_raw", "value")
def _(spark, sf):
    return estimate.template_entries(templates(spark, sf), K)


@query("filled_templates", "G5", "SELECT * FROM gated", "gated", "value")
def _(spark, sf):
    return gated(spark, sf)


view(
    "open_share",
    f"""SELECT relation_id, patient_id, state_id, CASE WHEN own > {_TOLX} THEN e / own WHEN alle > {_TOLX} THEN col / alle ELSE 1.0 / {K} END AS open_share FROM
        (SELECT *, sum(e) OVER (PARTITION BY relation_id, patient_id) AS own, sum(e) OVER (PARTITION BY relation_id) AS alle, sum(e) OVER (PARTITION BY relation_id, state_id) AS col FROM g_tmpl)""",
    "g_tmpl",
)


@query("open_profiles", "G5", "SELECT * FROM open_share", "open_share", "open_share")
def _(spark, sf):
    return estimate.open_profiles(templates(spark, sf), ["relation_id"], K)


view(
    "medoid_coords",
    "SELECT relation_id, patient_id, entry_type, row_id, col_id, value FROM gated WHERE entry_type <> 'e' UNION ALL SELECT relation_id, patient_id, 's', 0, state_id, open_share FROM open_share",
    "gated", "open_share",
)
view(
    "medoid_dist",
    "SELECT a.relation_id, a.patient_id, sum(abs(a.value - b.value)) AS distance FROM medoid_coords a JOIN medoid_coords b USING (relation_id, entry_type, row_id, col_id) GROUP BY 1, 2",
    "medoid_coords",
)


def medoid_coords(spark, sf):
    t = templates(spark, sf)
    relation = estimate.template_entries(estimate.filled_templates(t, ["relation_id"], K), K).where("entry_type <> 'e'")
    profile = estimate.open_profiles(t, ["relation_id"], K).select(
        *RK, F.lit("s").alias("entry_type"), F.lit(0).alias("row_id"), F.col("state_id").alias("col_id"), F.col("open_share").alias("value")
    )
    return relation.unionByName(profile)


@query("medoid_distances", "G6", "SELECT * FROM medoid_dist", "medoid_dist", "distance")
def _(spark, sf):
    return estimate.medoid_distances(medoid_coords(spark, sf), ["relation_id"])


@query(
    "medoid_patient", "G6",
    "SELECT relation_id, patient_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY round(distance, 9), patient_id) AS rn FROM medoid_dist) WHERE rn = 1", "medoid_dist", "distance",
)
def _(spark, sf):
    return estimate.medoid(medoid_coords(spark, sf), ["relation_id"])


@query(
    "endpoint_overlap", "G7",
    "SELECT relation_id, avg(o) AS matched_mass_budget, count(*) AS n_pairs FROM (SELECT relation_id, patient_id, sum(least(x, y)) AS o FROM endpoints GROUP BY 1, 2) GROUP BY 1", "endpoints", "matched_mass_budget",
)
def _(spark, sf):
    return estimate.matched_budget(estimate.endpoint_overlap(endpoints(spark, sf)), ["relation_id"])


_NMIN = 0.25


def masses(spark, sf):
    """Endpoint pairs as masses, some emptied so that every screening status occurs."""
    x0 = F.get("x", F.lit(0))
    zero = lambda c, when: F.transform(c, lambda v: F.when(when, 0.0).otherwise(v))
    return endpoints(spark, sf).select(
        *RK, zero("x", x0 < 0.16).alias("a"), zero("y", F.get("y", F.lit(1)) < 0.18).alias("b")
    )


view(
    "masses",
    """SELECT relation_id, patient_id, state_id, CASE WHEN min(x) FILTER (state_id = 0) OVER w < 0.16 THEN 0 ELSE x END AS a, CASE WHEN min(y) FILTER (state_id = 1) OVER w < 0.18 THEN 0 ELSE y END AS b
       FROM endpoints WINDOW w AS (PARTITION BY relation_id, patient_id)""",
    "endpoints",
)


@query(
    "active_support", "G8",
    f"SELECT relation_id, patient_id, count(*) FILTER (a + b >= {_NMIN}) AS n_active, CASE WHEN sum(a + b) > 0 THEN sum(CASE WHEN a + b < {_NMIN} THEN a + b ELSE 0 END) / sum(a + b) ELSE 0 END AS mass_pruned_ratio FROM masses GROUP BY 1, 2",
    "masses", "mass_pruned_ratio",
)
def _(spark, sf):
    out = estimate.active_support(masses(spark, sf), _NMIN)
    return out.select(*RK, F.size(F.filter("active", lambda k: k)).cast("long").alias("n_active"), "mass_pruned_ratio")


@query(
    "screen_pairs", "G9",
    f"""SELECT relation_id, patient_id, CASE WHEN sum(a) <= 0 THEN 'ERR_UOT_EMPTY_MASS_SOURCE' WHEN sum(b) <= 0 THEN 'ERR_UOT_EMPTY_MASS_TARGET'
        WHEN count(*) FILTER (a + b >= {_NMIN}) = 0 OR sum(CASE WHEN a + b >= {_NMIN} THEN a ELSE 0 END) <= 0 OR sum(CASE WHEN a + b >= {_NMIN} THEN b ELSE 0 END) <= 0 THEN 'ERR_UOT_EMPTY_SUPPORT' ELSE 'ok' END AS status
        FROM masses GROUP BY 1, 2""",
    "masses",
)
def _(spark, sf):
    return estimate.screen_pairs(masses(spark, sf), _NMIN).select(*RK, "status")


_TAU_COST = 0.8
view("gplan", "SELECT relation_id, patient_id, a.i, a.j, a.a * t.x AS mass FROM g_a a JOIN g_tmpl t USING (relation_id, patient_id) WHERE t.state_id = a.i", "g_a", "g_tmpl")


def gated_plan(spark, sf):
    t = templates(spark, sf)
    plan = t.select(*RK, F.col("state_id").alias("i"), "x", F.posexplode("a").alias("j", "v")).select(*RK, "i", "j", (F.col("x") * F.col("v")).alias("mass"))
    return plan, t.select(*RK, "state_id", "x", "y")


@query(
    "plan_metrics", "G10",
    f"""SELECT relation_id, patient_id, p."T", m."D_pos", m."B_pos", m."D_pos" / m.sx AS d_rel, m."B_pos" / m.sy AS b_rel, p.tc / p."T" AS "M", p.tt / p."T" AS "R" FROM
        (SELECT relation_id, patient_id, sum(mass) AS "T", sum(mass * cost) AS tc, sum(CASE WHEN cost <= {_TAU_COST} THEN mass ELSE 0 END) AS tt FROM gplan JOIN idcost USING (i, j) GROUP BY 1, 2) p
        JOIN (SELECT relation_id, patient_id, sum(greatest(x - r, 0)) AS "D_pos", sum(greatest(y - c, 0)) AS "B_pos", sum(x) AS sx, sum(y) AS sy FROM g_tmpl
          JOIN (SELECT relation_id, patient_id, i AS state_id, sum(mass) AS r FROM gplan GROUP BY 1, 2, 3) USING (relation_id, patient_id, state_id)
          JOIN (SELECT relation_id, patient_id, j AS state_id, sum(mass) AS c FROM gplan GROUP BY 1, 2, 3) USING (relation_id, patient_id, state_id) GROUP BY 1, 2) m USING (relation_id, patient_id)""",
    "gplan idcost g_tmpl", "T D_pos B_pos d_rel b_rel M R",
)
def _(spark, sf):
    plan, m = gated_plan(spark, sf)
    return estimate.plan_metrics(plan, m, identity_cost(spark, sf), _TAU_COST, RK)


@query(
    "predicted_targets", "G1",
    """SELECT relation_id, patient_id, fov_id, col_id AS state_id, raw / sum(raw) OVER (PARTITION BY relation_id, patient_id, fov_id) AS predicted FROM
       (SELECT relation_id, patient_id, fov_id, col_id, sum(v) AS raw FROM
        (SELECT r.relation_id, r.patient_id, r.fov_id, g.col_id, c.fraction * g.value AS v FROM rel_fovs r JOIN comp c USING (patient_id, timepoint, fov_id)
           JOIN gated g ON g.relation_id = r.relation_id AND g.patient_id = r.patient_id AND g.entry_type = 'A' AND g.row_id = c.state_id WHERE r.side = 'source'
         UNION ALL SELECT r.relation_id, r.patient_id, r.fov_id, g.col_id, g.value FROM rel_fovs r JOIN gated g ON g.relation_id = r.relation_id AND g.patient_id = r.patient_id AND g.entry_type = 'e' WHERE r.side = 'source')
        GROUP BY 1, 2, 3, 4)""",
    "rel_fovs comp gated", "predicted",
)
def _(spark, sf):
    vec = base.fov_vectors(spark, sf).join(base.sides(spark).where("side = 'source'"), ["timepoint", "domain_label"])
    out = estimate.predict_targets(vec.select(*RK, "fov_id", "fractions"), gated(spark, sf), RK, K)
    return out.select(*RK, "fov_id", F.posexplode("predicted").alias("state_id", "predicted"))


view("cohort", "SELECT relation_id, entry_type, row_id, col_id, avg(value) AS value, count(*) AS n_patients FROM gated GROUP BY 1, 2, 3, 4", "gated")
view(
    "cohort_sum",
    f"SELECT relation_id, max(n) AS support_n_patients, sum(v) / {K} AS dispersion FROM (SELECT relation_id, entry_type, row_id, col_id, count(*) AS n, var_pop(value) AS v FROM gated GROUP BY 1, 2, 3, 4) GROUP BY 1", "gated",
)


@query("cohort_template", "G18", "SELECT * FROM cohort", "cohort", "value")
def _(spark, sf):
    return estimate.cohort_template(gated(spark, sf))


@query("cohort_summary", "G18", "SELECT * FROM cohort_sum", "cohort_sum", "dispersion")
def _(spark, sf):
    return estimate.cohort_summary(gated(spark, sf), K)


@query(
    "relation_marginals", "G19",
    """SELECT relation_id, patient_id, state_id, sum(mi) AS mu_minus, sum(pl) AS mu_plus FROM
       (SELECT relation_id, patient_id, row_id AS state_id, value AS mi, 0 AS pl FROM gated WHERE entry_type <> 'e'
        UNION ALL SELECT relation_id, patient_id, col_id, 0, value FROM gated WHERE entry_type <> 'd') GROUP BY 1, 2, 3""",
    "gated", "mu_minus mu_plus",
)
def _(spark, sf):
    return estimate.marginals(gated(spark, sf), RK)


@query(
    "conditional_kernel", "G20",
    """SELECT a.relation_id, a.patient_id, a.row_id, a.col_id, CASE WHEN 1 - d.value > 0 THEN a.value / (1 - d.value) END AS probability
       FROM gated a JOIN gated d USING (relation_id, patient_id, row_id) WHERE a.entry_type = 'A' AND d.entry_type = 'd'""",
    "gated", "probability",
)
def _(spark, sf):
    return estimate.conditional_kernel(gated(spark, sf), RK, K)


# Block losses for the ledger: total variation between the two sides of each block.
view(
    "block_loss",
    """SELECT relation_id, patient_id, subbag_index, sum(abs(x - y)) / 2 AS loss FROM
       (SELECT b.relation_id, b.patient_id, b.subbag_index, c.state_id, avg(c.fraction) FILTER (b.side = 'source') AS x, avg(c.fraction) FILTER (b.side = 'target') AS y
        FROM blocks b JOIN comp c USING (patient_id, timepoint, fov_id) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    "blocks", "comp",
)


def block_losses(spark, sf):
    vec = base.fov_vectors(spark, sf).drop("domain_label")
    rows = blocks(spark, sf).join(vec, ["patient_id", "timepoint", "fov_id"])

    def mean(side):
        return F.array(*[F.avg(F.when(F.col("side") == side, F.get("fractions", F.lit(k)))) for k in range(K)])

    means = rows.groupBy(*RK, "subbag_index").agg(mean("source").alias("x"), mean("target").alias("y"))
    return means.select(*RK, "subbag_index", (estimate.vsum(F.zip_with("x", "y", lambda a, b: F.abs(a - b))) / 2).alias("loss"))


@query(
    "objective_ledger", "G16",
    f"""SELECT relation_id, observation_raw, observation_raw / 0.2 AS observation, within_patient, open_loss, geometry, dispersion AS recurrence,
        (observation_raw / 0.2 + within_patient + (open_loss + 0.01 * geometry) / 2 + dispersion / 0.01) / 3 AS total FROM
        (SELECT relation_id, avg(m) AS observation_raw, avg(v) AS within_patient FROM (SELECT relation_id, patient_id, avg(loss) AS m, var_pop(loss / 0.2) AS v FROM block_loss GROUP BY 1, 2) GROUP BY 1)
        JOIN (SELECT relation_id, avg(value) FILTER (entry_type = 'd') + avg(value) FILTER (entry_type = 'e') AS open_loss FROM gated GROUP BY 1) USING (relation_id)
        JOIN (SELECT relation_id, avg(g) AS geometry FROM (SELECT relation_id, patient_id, sum(value * cost) / {K} AS g FROM gated JOIN idcost ON i = row_id AND j = col_id WHERE entry_type = 'A' GROUP BY 1, 2) GROUP BY 1) USING (relation_id)
        JOIN cohort_sum USING (relation_id)""",
    "block_loss gated idcost cohort_sum", "observation_raw observation within_patient open_loss geometry recurrence total",
)
def _(spark, sf):
    return estimate.objective_ledger(block_losses(spark, sf), gated(spark, sf), identity_cost(spark, sf), 0.2, 1.0, K)


@query(
    "block_scales", "G15",
    """SELECT relation_id, patient_id, n_pairs, coalesce(m, 1.0) AS scale, m IS NULL AS scale_defaulted FROM
       (SELECT relation_id, patient_id, count(*) AS n_pairs, median(loss) FILTER (loss > 0) AS m FROM (SELECT * REPLACE (CASE WHEN loss < 0.3 THEN 0 ELSE loss END AS loss) FROM block_loss) GROUP BY 1, 2)""",
    "block_loss", "scale",
)
def _(spark, sf):
    costs = block_losses(spark, sf).withColumn("cost", F.when(F.col("loss") < 0.3, 0.0).otherwise(F.col("loss")))
    return estimate.block_scales(costs, RK)


# --- exports of relations ----------------------------------------------------


@query(
    "relation_export", "A14",
    "SELECT relation_id, count(DISTINCT patient_id) AS n_records, count(*) AS n_values, 'ok' AS status FROM gated GROUP BY 1", "gated",
)
def _(spark, sf):
    path = scratch_path(spark, "relations")
    sinks.export_relations(gated(spark, sf), path)
    return sinks.relation_record_counts(spark.read.parquet(path), ["relation_id"])


@query(
    "null_fit_cache", "A20",
    "SELECT permutation_index, count(DISTINCT patient_id) AS n_records, count(*) AS n_values, 'ok' AS status FROM null_raw GROUP BY 1", "null_raw",
)
def _(spark, sf):
    path = scratch_path(spark, "null-fits")
    t = estimate.gated_templates(null_endpoints(spark, sf), identity_cost(spark, sf), TAU)
    sinks.export_relations(estimate.template_entries(t, K), path, "permutation_index")
    return sinks.relation_record_counts(spark.read.parquet(path), ["permutation_index"])


@query(
    "cohort_table", "A15 H1",
    f"""SELECT relation_id, entry_type, row_id, col_id, value, CASE WHEN row_id < {K} THEN 'C' || row_id ELSE 'open' END AS row_label FROM
        (SELECT relation_id, entry_type, row_id, col_id, value FROM cohort UNION ALL SELECT DISTINCT relation_id, 'masked', {K}, {K}, NULL FROM cohort)""",
    "cohort", "value",
)
def _(spark, sf):
    out = summary.augmented_entries(estimate.cohort_template(gated(spark, sf)), K, ["relation_id"])
    label = F.when(F.col("row_id") < K, F.concat(F.lit("C"), F.col("row_id").cast("string"))).otherwise("open")
    return out.withColumn("row_label", label)


@query(
    "vector_json_entries", "A19",
    "SELECT relation_id, patient_id, row_id AS i, value FROM gated WHERE entry_type = 'd'", "gated", "value",
)
def _(spark, sf):
    d = gated(spark, sf).where("entry_type = 'd'")
    return sinks.from_vector_json(sinks.vector_json(d, RK, "row_id", "value", "d_json"), "d_json", "i", "value")


# --- checks on relations -----------------------------------------------------

view("flawed_entries", "SELECT relation_id, patient_id, entry_type, row_id, col_id, CASE WHEN entry_type = 'A' AND value > 0.95 THEN -value WHEN entry_type = 'e' AND value > 0.05 THEN 2.0 ELSE value END AS value FROM gated", "gated")


@query(
    "bad_relations", "B7",
    """SELECT * FROM (SELECT relation_id, patient_id, CASE WHEN entry_type = 'e' THEN 'target' ELSE 'source' END AS axis, CASE WHEN entry_type = 'e' THEN col_id ELSE row_id END AS axis_id,
       count(*) FILTER (value < 0 OR (entry_type = 'e' AND value > 1)) AS n_bad, sum(value) AS total FROM flawed_entries GROUP BY 1, 2, 3, 4) WHERE n_bad > 0 OR (axis = 'source' AND abs(total - 1) > 1e-8)""",
    "flawed_entries", "total",
)
def _(spark, sf):
    v, kind = F.col("value"), F.col("entry_type")
    flawed = gated(spark, sf).withColumn("value", F.when((kind == "A") & (v > 0.95), -v).when((kind == "e") & (v > 0.05), 2.0).otherwise(v))
    return quality.bad_relations(flawed)


@query(
    "augmented_grid_problems", "B16",
    """SELECT relation_id, 'A' AS entry_type, row_id, col_id, 'missing' AS problem FROM cohort WHERE entry_type = 'A' AND row_id = 1
       UNION ALL SELECT relation_id, 'd', row_id, col_id, 'repeated' FROM cohort WHERE entry_type = 'd' AND row_id = 2""",
    "cohort",
)
def _(spark, sf):
    c = estimate.cohort_template(gated(spark, sf)).select("relation_id", *COORD, "value")
    holes = c.where(~((F.col("entry_type") == "A") & (F.col("row_id") == 1)))
    return quality.augmented_grid_problems(holes.unionByName(c.where("entry_type = 'd' AND row_id = 2")), ["relation_id"], K)


@query(
    "blocking_fits", "B19",
    """SELECT relation_id, CAST(sum(n) AS BIGINT) AS n_blocking, string_agg(fit_status || ':' || n, ',' ORDER BY fit_status || ':' || n) AS reasons FROM
       (SELECT relation_id, fit_status, count(*) AS n FROM fits WHERE fit_status <> 'ok' GROUP BY 1, 2) GROUP BY 1""",
    "fits",
)
def _(spark, sf):
    return quality.blocking_fits(fits(spark, sf))


# A relation counts as failed when too little of its source mass is kept in place.
view(
    "fits",
    """SELECT s.relation_id, s.patient_id, CASE WHEN s.status <> 'eligible' THEN 'deferred' WHEN f.patient_id IS NOT NULL THEN 'ok' ELSE 'failed' END AS fit_status,
       CASE WHEN s.status <> 'eligible' THEN s.status END AS defer_reason FROM (SELECT relation_id, patient_id, n_source, n_target, CASE WHEN n_source < 8 THEN 'missing_source' ELSE status END AS status FROM support) s
       LEFT JOIN (SELECT relation_id, patient_id FROM endpoints GROUP BY 1, 2 HAVING sum(least(x, y)) > 0.86) f USING (relation_id, patient_id)""",
    "support", "endpoints",
)


def fits(spark, sf):
    thin = support(spark, sf).withColumn("status", F.when(F.col("n_source") < 8, "missing_source").otherwise(F.col("status")))
    done = estimate.endpoint_overlap(endpoints(spark, sf)).where("overlap > 0.86")
    return summary.fit_status(thin, done)


# --- summaries ---------------------------------------------------------------


@query(
    "grouped_entries", "H2",
    f"SELECT relation_id, patient_id, entry_type, row_id, col_id, value, group_id FROM gated LEFT JOIN grps USING (patient_id) WHERE relation_id IN ('{LEFT}', 'pre_AUTOMOBILE_to_post_AUTOMOBILE')", "gated grps", "value",
)
def _(spark, sf):
    return summary.grouped_entries(gated(spark, sf), base.groups(spark, sf), [LEFT, base.RIGHT])


view(
    "contin",
    """SELECT *, total_continuity_mass - diagonal_mass AS offdiagonal_mass, total_continuity_mass / (total_continuity_mass + total_depletion_mass + total_emergence_mass) AS continuity_fraction,
       (total_depletion_mass + total_emergence_mass) / (total_continuity_mass + total_depletion_mass + total_emergence_mass) AS open_fraction FROM
       (SELECT relation_id, patient_id, sum(CASE WHEN entry_type = 'A' AND row_id = col_id THEN value ELSE 0 END) AS diagonal_mass, sum(CASE WHEN entry_type = 'A' THEN value ELSE 0 END) AS total_continuity_mass,
        sum(CASE WHEN entry_type = 'd' THEN value ELSE 0 END) AS total_depletion_mass, sum(CASE WHEN entry_type = 'e' THEN value ELSE 0 END) AS total_emergence_mass FROM gated GROUP BY 1, 2)""",
    "gated",
)


@query("continuity_totals", "H3", "SELECT * FROM contin", "contin", "diagonal_mass offdiagonal_mass total_continuity_mass total_depletion_mass total_emergence_mass continuity_fraction open_fraction")
def _(spark, sf):
    return summary.continuity(gated(spark, sf), RK)


@query(
    "pathology_flags", "H4",
    """SELECT relation_id, patient_id, coalesce(diag / nullif(tot, 0) > 0.99, false) AS diagonal_collapse, coalesce(op / nullif(tot + op, 0) > 0.95, false) AS open_channel_overuse, false AS nonfinite_payload FROM
       (SELECT relation_id, patient_id, sum(CASE WHEN entry_type = 'A' AND row_id = col_id THEN value ELSE 0 END) AS diag, sum(CASE WHEN entry_type = 'A' THEN value ELSE 0 END) AS tot,
        sum(CASE WHEN entry_type <> 'A' THEN value ELSE 0 END) AS op FROM diag GROUP BY 1, 2)""",
    "diag",
)
def _(spark, sf):
    return summary.pathologies(diagonal(spark, sf), RK)


def packed(spark, sf):
    return summary.packed_with_burden(gated(spark, sf), endpoints(spark, sf), RK, K)


def family_views(prefix: str, entries: str, ends: str, keys: str) -> None:
    """SQL of the family summaries for any entries and endpoints views."""
    view(
        f"{prefix}_src",
        f"""SELECT {keys}, r.row_id AS state_id, e.x, sum(CASE WHEN entry_type = 'A' AND row_id = col_id THEN value ELSE 0 END) AS ret, sum(CASE WHEN entry_type = 'd' THEN value ELSE 0 END) AS dep,
            sum(CASE WHEN entry_type = 'A' AND row_id <> col_id THEN value ELSE 0 END) AS off FROM {entries} r JOIN (SELECT {keys}, state_id AS row_id, x FROM {ends}) e USING ({keys}, row_id) WHERE entry_type <> 'e' GROUP BY {keys}, r.row_id, e.x""",
        entries, ends,
    )
    view(f"{prefix}_tgt", f"SELECT {keys}, r.col_id AS state_id, e.y, value AS eme FROM {entries} r JOIN (SELECT {keys}, state_id AS col_id, y FROM {ends}) e USING ({keys}, col_id) WHERE entry_type = 'e'", entries, ends)
    parts = []
    for name, role, axis, _ in summary.SUMMARIES:
        col = {"self_retention": "ret", "depletion": "dep", "off_diagonal_remodeling": "off", "emergence": "eme"}[name]
        side, w = (f"{prefix}_src", "x") if axis == "source" else (f"{prefix}_tgt", "y")
        for scale in summary.SCALES:
            value = f"sum({w} * {col}) / sum({w})" if scale == "burden_weighted" else f"avg({col}) FILTER ({w} > 0)"
            parts.append(
                f"SELECT {keys}, '{name}' AS summary_name, '{role}' AS summary_role, '{scale}' AS scale, {value} AS value, '{axis}' AS eligible_entity_axis, CAST(count(*) FILTER ({w} > 0) AS INT) AS eligible_entity_count, sum({w}) AS burden_total FROM {side} GROUP BY {keys}"
            )
    view(f"{prefix}_family", " UNION ALL ".join(parts), f"{prefix}_src", f"{prefix}_tgt")


family_views("f", "gated", "endpoints", "relation_id, patient_id")
family_views("fnull", "null_raw", "perm_endpoints", "permutation_index, patient_id")
family_views("freal", "real_raw", "real_endpoints", "permutation_index, patient_id")


def family(spark, sf):
    return summary.family_summaries(packed(spark, sf), RK)


@query("family_summaries", "H5", "SELECT * FROM f_family", "f_family", "value burden_total")
def _(spark, sf):
    return family(spark, sf)


view(
    "source_comm",
    """SELECT relation_id, patient_id, state_id AS source_community_id, x AS source_burden, CASE WHEN x > 0 THEN x / sum(x) OVER (PARTITION BY relation_id, patient_id) ELSE 0 END AS source_weight,
       CASE WHEN x > 0 THEN ret END AS self_retention, CASE WHEN x > 0 THEN dep END AS depletion, CASE WHEN x > 0 THEN off END AS off_diagonal_remodeling,
       CASE WHEN x > 0 THEN ret * x END AS self_retention_burden, CASE WHEN x > 0 THEN dep * x END AS depletion_burden, CASE WHEN x > 0 THEN off * x END AS off_diagonal_burden FROM f_src""",
    "f_src",
)
view(
    "target_comm",
    """SELECT relation_id, patient_id, state_id AS target_community_id, y AS target_burden, CASE WHEN y > 0 THEN y / sum(y) OVER (PARTITION BY relation_id, patient_id) ELSE 0 END AS target_weight,
       CASE WHEN y > 0 THEN inc END AS matched_incoming_burden, CASE WHEN y > 0 THEN eme END AS open_incoming_tendency, CASE WHEN y > 0 THEN eme * sx END AS open_incoming_burden
       FROM f_tgt JOIN (SELECT g.relation_id, g.patient_id, g.col_id AS state_id, sum(g.value * e.x) AS inc FROM gated g JOIN endpoints e ON e.relation_id = g.relation_id AND e.patient_id = g.patient_id AND e.state_id = g.row_id WHERE entry_type = 'A' GROUP BY 1, 2, 3) USING (relation_id, patient_id, state_id)
       JOIN (SELECT relation_id, patient_id, sum(x) AS sx FROM endpoints GROUP BY 1, 2) USING (relation_id, patient_id)""",
    "f_tgt", "gated", "endpoints",
)


@query(
    "source_communities", "H6", "SELECT * FROM source_comm", "source_comm",
    "source_burden source_weight self_retention depletion off_diagonal_remodeling self_retention_burden depletion_burden off_diagonal_burden",
)
def _(spark, sf):
    return summary.source_communities(packed(spark, sf), RK)


@query(
    "target_communities", "H7", "SELECT * FROM target_comm", "target_comm",
    "target_burden target_weight matched_incoming_burden open_incoming_tendency open_incoming_burden",
)
def _(spark, sf):
    return summary.target_communities(packed(spark, sf), RK)


@query("fit_status", "H8", "SELECT * FROM fits", "fits")
def _(spark, sf):
    return fits(spark, sf)


@query("fit_status_counts", "H8", "SELECT relation_id, fit_status, count(*) AS n_patients FROM fits GROUP BY 1, 2", "fits")
def _(spark, sf):
    return summary.status_counts(fits(spark, sf))


@query("continuity_score", "H9", "SELECT relation_id, patient_id, CASE WHEN total_continuity_mass > 0 THEN diagonal_mass / total_continuity_mass ELSE 0 END AS continuity_score FROM contin", "contin", "continuity_score")
def _(spark, sf):
    return summary.continuity_score(gated(spark, sf), RK)


@query(
    "fit_facts", "H10",
    """SELECT count(DISTINCT relation_id) AS n_relations, count(DISTINCT patient_id) AS n_patients, count(*) FILTER (fit_status <> 'ok') AS n_warnings, """
    + ", ".join(f"count(*) FILTER (fit_status = 'ok' AND relation_id = 'pre_{a}_to_post_{b}') AS support_{i}" for i, (a, b) in enumerate(base.PAIRS)) + " FROM fits",
    "fits",
)
def _(spark, sf):
    facts = summary.fit_facts(fits(spark, sf))
    cols = [F.element_at("support", F.lit(f"pre_{a}_to_post_{b}")).alias(f"support_{i}") for i, (a, b) in enumerate(base.PAIRS)]
    return facts.select("n_relations", "n_patients", "n_warnings", *cols)


_PERM = [3, 0, 4, 1, 2]


@query(
    "matrix_view", "H11",
    f"SELECT relation_id, row_id, CAST(CASE row_id {' '.join(f'WHEN {s} THEN {i}' for i, s in enumerate([*_PERM, K]))} END AS INT) AS row_position, "
    + ", ".join(f"max(CASE WHEN col_id = {s} THEN value END) AS c{i}" for i, s in enumerate([*_PERM, K])) + " FROM cohort GROUP BY 1, 2",
    "cohort", " ".join(f"c{i}" for i in range(K + 1)),
)
def _(spark, sf):
    return summary.matrix_view(estimate.cohort_template(gated(spark, sf)), ["relation_id"], _PERM, K)


@query(
    "summary_problems", "B22",
    """SELECT relation_id, patient_id, CASE WHEN ok AND f.patient_id IS NULL THEN 'missing_row' WHEN NOT ok AND f.patient_id IS NOT NULL THEN 'row_without_fit' END AS problem
       FROM (SELECT relation_id, patient_id, fit_status = 'ok' AS ok FROM fits) s FULL JOIN (SELECT DISTINCT relation_id, patient_id FROM f_family) f USING (relation_id, patient_id)
       WHERE (ok AND f.patient_id IS NULL) OR (NOT ok AND f.patient_id IS NOT NULL)""",
    "fits f_family",
)
def _(spark, sf):
    names = [n for n, *_ in summary.SUMMARIES]
    return quality.summary_problems(family(spark, sf), fits(spark, sf), names, summary.SCALES)
