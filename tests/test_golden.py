"""Small tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import compose, estimate, neighbors, pairing, programs, quality, stats
from fovea.operators.kernels import divergence
from fovea.sources import load


def cell_table(spark, rows):
    return spark.createDataFrame(rows, "patient_id string, timepoint string, fov_id string, domain_label string, state_id int")


G1 = [
    ("p1", "t0", "f1", "TC", 0), ("p1", "t0", "f1", "TC", 1), ("p1", "t0", "f1", "TC", 1),
    ("p1", "t1", "f2", "IM", 2), ("p1", "t1", "f2", "IM", 2),
    ("p2", "t0", "f1", "TC", 0), ("p2", "t0", "f1", "TC", 0), ("p2", "t0", "f1", "TC", 2),
    ("p2", "t1", "f3", "IM", 1), ("p2", "t1", "f3", "IM", 2),
]


@pytest.mark.parametrize("limit", [64, 1])
def test_fov_composition(spark, monkeypatch, limit):
    monkeypatch.setattr(compose, "WIDE_STATE_LIMIT", limit)
    out = {(r.patient_id, r.fov_id, r.state_id): r.fraction for r in compose.fov_composition(cell_table(spark, G1), 3).collect()}
    expected = {("p1", "f1"): (1 / 3, 2 / 3, 0), ("p1", "f2"): (0, 0, 1), ("p2", "f1"): (2 / 3, 0, 1 / 3), ("p2", "f3"): (0, 0.5, 0.5)}
    for (patient, fov), fractions in expected.items():
        for k, value in enumerate(fractions):
            assert out[(patient, fov, k)] == pytest.approx(value)


def test_layouts_of_few_and_many_states_agree(spark, monkeypatch):
    few = {tuple(r) for r in compose.fov_composition(cell_table(spark, G1), 3).collect()}
    many = {tuple(r) for r in compose.fov_composition(cell_table(spark, G1), 65).where("state_id < 3").collect()}
    assert few == many
    for limit in (64, 1):
        monkeypatch.setattr(compose, "WIDE_STATE_LIMIT", limit)
        for state in (3, -1, None):
            with pytest.raises(Exception, match="state ids"):
                compose.fov_composition(cell_table(spark, G1 + [("p9", "t0", "f1", "TC", state)]), 3).collect()


def test_incomplete_relations_are_refused(spark):
    rows = entries_of([("p1", [[0.5, 0.2], [0.1, 0.6]], [0.3, 0.3], [0.1, 0.1])])[:-3]
    entries = spark.createDataFrame(rows, "relation_id string, patient_id string, entry_type string, row_id int, col_id int, value double")
    with pytest.raises(Exception, match="incomplete"):
        programs.tensor_rows(entries.where("NOT (entry_type = 'A' AND row_id = 0 AND col_id = 1)"), 2).collect()


def test_mixed_domains_are_reported(spark):
    rows = G1 + [("p1", "t0", "f1", "PT", 0)]
    assert [r.fov_id for r in quality.mixed_domain_fovs(cell_table(spark, rows)).collect()] == ["f1"]
    with pytest.raises(load.ContractError):
        quality.require_clean(quality.mixed_domain_fovs(cell_table(spark, rows)), "domains")


def spatial(spark, rows):
    return spark.createDataFrame(
        [("p", "t", f, c, float(x), float(y), s) for f, c, x, y, s in rows],
        "patient_id string, timepoint string, fov_id string, cell_id string, x double, y double, cell_subtype_label string",
    )


def test_neighbour_mix(spark):
    rows = [("f1", f"a{i}", i, 0, s) for i, s in enumerate("aab")] + [("f2", f"b{i}", i, 0, s) for i, s in enumerate("bba")]
    mix = neighbors.neighborhood_vectors(spatial(spark, rows), 2, ["a", "b"])
    got = {r.cell_id: tuple(r.features) for r in mix.collect()}
    assert got == {"a0": (0.5, 0.5), "a1": (0.5, 0.5), "a2": (1, 0), "b0": (0.5, 0.5), "b1": (0.5, 0.5), "b2": (0, 1)}


def test_coincident_cells_stay_neighbours(spark):
    rows = [("f", f"c{i + 1}", x, 0, s) for i, (x, s) in enumerate(zip([0, 0, 1, 2], "abbb"))]
    got = {r.cell_id: tuple(r.features) for r in neighbors.neighborhood_vectors(spatial(spark, rows), 2, ["a", "b"]).collect()}
    assert got["c1"] == (0, 1) and got["c2"] == (0.5, 0.5) and got["c3"] == (0.5, 0.5)
    assert got["c4"] in ((0, 1), (0.5, 0.5))


def test_small_fov_modes(spark):
    cells = spatial(spark, [("f", "c1", 0, 0, "a"), ("f", "c2", 1, 0, "b")])
    assert neighbors.nearest_neighbors(cells, 2, "quarantine").count() == 0
    assert neighbors.nearest_neighbors(cells, 2, "shrink").count() == 2
    with pytest.raises(ValueError):
        neighbors.nearest_neighbors(cells, 2)


def test_coordinates_must_be_numbers(spark):
    for bad in (None, float("nan"), float("inf")):
        for n in (20, 200):
            rows = [("p", "t", "f", f"c{i}", float(i), 0.0, "a") for i in range(n)] + [("p", "t", "f", "bad", bad, 0.0, "a")]
            cells = spark.createDataFrame(rows, spatial(spark, []).schema)
            with pytest.raises(Exception, match="finite"):
                neighbors.nearest_neighbors(cells, 2).collect()


def test_types_outside_the_list_are_refused(spark):
    with pytest.raises(Exception, match="type"):
        neighbors.neighborhood_vectors(spatial(spark, [("f", f"c{i}", i, 0, "abz"[i]) for i in range(3)]), 2, ["a", "b"]).collect()


@pytest.mark.parametrize("kind", ["uniform", "clustered", "one_place"])
def test_large_fov_matches_full_search(spark, kind):
    rng = np.random.default_rng(7)
    n, k = 700, 5
    xy = rng.random((n, 2)) * 100
    if kind == "clustered":
        xy[:450] = 50 + rng.random((450, 2)) * 0.01
    if kind == "one_place":
        xy[:300] = [10.0, 10.0]
    cells = spatial(spark, [("f", f"c{i:04d}", *p, "a") for i, p in enumerate(xy)])
    got = {}
    for r in neighbors.nearest_neighbors(cells, k).collect():
        got.setdefault(r.cell_id, {})[r["rank"]] = r.neighbor_id
    d2 = ((xy[:, None, 0] - xy[None, :, 0]) ** 2) + ((xy[:, None, 1] - xy[None, :, 1]) ** 2)
    assert len(got) == n
    for i in range(n):
        order = sorted((d2[i, j], f"c{j:04d}") for j in range(n) if j != i)[:k]
        assert [got[f"c{i:04d}"][r + 1] for r in range(k)] == [name for _, name in order]


@pytest.mark.parametrize("k", [3, 40])
def test_large_fovs_write_cells_and_no_neighbour_lists(spark, monkeypatch, k):
    rng = np.random.default_rng(11)
    sizes, scale = {"f1": 500, "f2": 130, "f3": 40}, {"f1": 1e-3, "f2": 1e6, "f3": 1.0}
    rows = [(f, f"{f}-{i:04d}", *np.round(rng.random(2) * 30) * scale[f], "ab"[i % 2]) for f, n in sizes.items() for i in range(n)]
    rows += [("f1", f"f1-z{i:03d}", 0.004, 0.004, "b") for i in range(60)]
    written, kept = [], neighbors.durable
    monkeypatch.setattr(neighbors, "durable", lambda df: written.append(df) or kept(df))
    got = {}
    for r in neighbors.nearest_neighbors(spatial(spark, rows), k, "shrink").collect():
        got.setdefault(r.cell_id, []).append((r["rank"], r.neighbor_id, r.distance))
    for f in sizes:
        own = [r for r in rows if r[0] == f]
        for _, cell, x, y, _ in own:
            near = sorted(((b[2] - x) ** 2 + (b[3] - y) ** 2, b[1]) for b in own if b[1] != cell)[:k]
            assert [(n, pytest.approx(d)) for _, n, d in sorted(got[cell])] == [(n, d2**0.5) for d2, n in near]
    assert written and not [df for df in written if "near" in df.columns]


def test_small_fovs_are_solved_in_arrow_batches(spark, monkeypatch):
    rows = [(f"f{f}", f"c{f}-{i:02d}", (i * 7) % 5, (i * 3) % 4, "ab"[i % 2]) for f in range(60) for i in range(1 + f % 30)]
    lists = neighbors.nearest_lists(spatial(spark, rows), 4, ["cell_subtype_label"], "shrink")
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_sort" not in plan
    got = {r.cell_id: [(n.dist2, n.neighbor_id, n.cell_subtype_label) for n in r.near] for r in lists.collect()}
    assert len(got) == len(rows)
    for f, cell, x, y, _ in rows:
        assert got[cell] == sorted(((b[2] - x) ** 2 + (b[3] - y) ** 2, b[1], b[4]) for b in rows if b[0] == f and b[1] != cell)[:4]


def test_block_draws_are_counted_in_their_row(spark):
    rows = [(f, f"{f}-{i}", i % 7, i % 5, "a") for f in ("f1", "f2", "f3") for i in range(40)]
    blocks = neighbors.grid_blocks(spatial(spark, rows), 3)
    drawn = neighbors.block_bootstrap(blocks, 3, 4, "42")
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # boxes, block sizes, blocks of a FOV
    per_fov = {f: blocks.where(f"fov_id = '{f}'").select("block_row", "block_col").distinct().count() for f in ("f1", "f2", "f3")}
    got = drawn.groupBy("fov_id", "replicate").sum("n_drawn").collect()
    assert len(got) == 12 and all(r["sum(n_drawn)"] == per_fov[r.fov_id] for r in got)


def test_balanced_parts(spark):
    df = spark.range(5).select(pairing.part_index(F.col("id"), F.lit(5), F.lit(2)).alias("part"))
    assert [r.part for r in df.collect()] == [0, 0, 0, 1, 1]
    sizes = spark.range(23).select(pairing.part_index(F.col("id"), F.lit(23), F.lit(6)).alias("p")).groupBy("p").count().collect()
    assert len(sizes) == 6 and {r["count"] for r in sizes} == {3, 4}


def test_blocks_pair_ordered_fovs(spark):
    rows = [("r", "p", s, "t", "D", f) for s, f in (("source", "fov_b"), ("source", "fov_a"), ("target", "fov_c"), ("target", "fov_d"))]
    chosen = spark.createDataFrame(rows, "relation_id string, patient_id string, side string, timepoint string, domain_label string, fov_id string")
    support = pairing.relation_support(chosen)
    assert support.first()["status"] == "eligible"
    blocks = pairing.with_block_id(pairing.evidence_blocks(pairing.ordered_bags(chosen), support)).collect()
    got = {(r.block_id, r.side): r.fov_id for r in blocks}
    assert got == {("p:subbag_0", "source"): "fov_a", ("p:subbag_1", "source"): "fov_b", ("p:subbag_0", "target"): "fov_c", ("p:subbag_1", "target"): "fov_d"}


def test_permutations_keep_label_counts(spark):
    rows = [("p1", f"t{i % 2}", f"f{i // 2}", "A" if i < 7 else "B") for i in range(20)] + [("p2", "t0", "g1", "A"), ("p2", "t0", "g2", "B")]
    fovs = spark.createDataFrame(rows, "patient_id string, timepoint string, fov_id string, domain_label string")
    out = pairing.permuted_labels(fovs, 12, 3)
    counts = {(r.permutation_index, r.patient_id, r.permuted_domain_label): r["count"] for r in out.groupBy("permutation_index", "patient_id", "permuted_domain_label").count().collect()}
    for i in range(12):
        assert counts[(i, "p1", "A")] == 7 and counts[(i, "p1", "B")] == 13 and counts[(i, "p2", "A")] == 1
    assert out.where("patient_id = 'p1'").groupBy("timepoint", "fov_id").agg(F.count_distinct("permuted_domain_label").alias("n")).where("n = 2").count() > 10


def test_copies_of_fovs_are_never_broadcast(spark, tmp_path):
    """The optimizer does not count the rows of an explode, so it took the copies for the small side."""
    rows = [("p1", "t0", f"f{i}", "A" if i < 70 else "B") for i in range(200)]
    spark.createDataFrame(rows, "patient_id string, timepoint string, fov_id string, domain_label string").write.parquet(str(tmp_path / "fovs"))
    out = pairing.permuted_labels(spark.read.parquet(str(tmp_path / "fovs")), 12, 3)
    depth = None
    for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        assert depth is None or "Generate" not in line, line
        depth = at if depth is None and "BroadcastExchange" in line else depth
    assert out.groupBy("permutation_index").agg(F.count_if(F.col("permuted_domain_label") == "A").alias("n")).where("n = 70").count() == 12


def test_tables_of_blocks_are_never_broadcast(spark, tmp_path):
    """Small files of many FOVs are large tables at the driver."""
    rows = [("r", "p1", i, side, f"{side}{i}", side, "A") for i in range(50) for side in ("source", "target")]
    spark.createDataFrame(rows, "relation_id string, patient_id string, subbag_index int, side string, fov_id string, timepoint string, domain_label string").write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    blocks.select("patient_id", "timepoint", "fov_id", "domain_label", F.array(F.lit(1.0)).alias("fractions")).write.parquet(str(tmp_path / "vectors"))
    pairs = pairing.block_pairs(blocks, spark.read.parquet(str(tmp_path / "vectors")))
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 50


def entries_of(rows):
    """Dense K=2 entries: A, d, e per patient."""
    out = []
    for patient, a, d, e in rows:
        out += [("r", patient, "A", i, j, float(a[i][j])) for i in range(2) for j in range(2)]
        out += [("r", patient, "d", i, 2, float(d[i])) for i in range(2)] + [("r", patient, "e", 2, j, float(e[j])) for j in range(2)]
    return out


ENTRY_SCHEMA = "relation_id string, patient_id string, entry_type string, row_id int, col_id int, value double"


def test_group_association(spark):
    rows = []
    for i, patient in enumerate(["p1", "p2", "p3", "p4", "p5", "p6"]):
        x = 0.9 - 0.1 * i
        rows.append((patient, [[x, 0.9 - x], [0.9 - x, x]], [0.1, 0.1], [0.01 * (i + 1), 0.02 * (i + 1)]))
    groups = spark.createDataFrame([(f"p{i}", "low" if i <= 3 else "high") for i in range(1, 7)], "patient_id string, group_id string")
    comparisons = spark.createDataFrame([("low_vs_high", ["low", "high"])], "comparison_id string, groups array<string>")
    tests = stats.group_association(stats.entry_rows(spark.createDataFrame(entries_of(rows), ENTRY_SCHEMA), groups, comparisons), stats.ENTRY_UNIT)
    got = {(r.entry_type, r.row_id, r.col_id): r for r in tests.collect()}
    assert len(got) == 8 and ("A", 2, 2) not in got
    assert got[("A", 0, 0)].effect_size == 1.0 and got[("A", 0, 0)].effect_direction == "low>high"
    for key, row in got.items():
        flat = key[0] == "d"
        assert row.p_value == pytest.approx(1.0 if flat else 0.1)
        assert row.q_value == pytest.approx(1.0 if flat else 0.1 * 8 / 6)
        assert row.correction_scope == "r:low_vs_high" and row.n_by_group == {"low": 3, "high": 3}


def test_three_groups(spark):
    values = {"a": [0.1, 0.2, 0.3], "b": [0.4, 0.5, 0.6], "c": [0.2, 0.9, 0.4]}
    rows = [("r", f"{g}{i}", g, "A", 0, 0, v) for g, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "relation_id string, patient_id string, group_id string, entry_type string, row_id int, col_id int, value double")
    comparisons = spark.createDataFrame([("all", ["a", "b", "c"])], "comparison_id string, groups array<string>")
    row = stats.group_association(stats.comparison_rows(df, comparisons), stats.ENTRY_UNIT).first()
    data = [np.array(v) for v in values.values()]
    grand = np.concatenate(data).mean()
    between = sum(len(d) * (d.mean() - grand) ** 2 for d in data)
    total = ((np.concatenate(data) - grand) ** 2).sum()
    assert row.test_name == "one_way_anova" and row.effect_size == pytest.approx(between / total)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("s", p) for p in (0.01, 0.03, 0.03, 0.04, 0.5)] + [("s", None)], "scope string, p_value double")
    got = sorted((r.p_value, round(r.q_value, 12)) for r in stats.with_bh(df, ["scope"]).where("p_value IS NOT NULL").collect())
    assert got == [(0.01, 0.05), (0.03, 0.05), (0.03, 0.05), (0.04, 0.05), (0.5, 0.5)]


def test_divergence_kernel():
    a = np.array([[0.7, 0.2, 0.1], [0.1, 0.6, 0.3]])
    b = np.array([[0.5, 0.3, 0.2], [0.2, 0.5, 0.3]])
    cost = np.array([[0, 1, 2], [1, 0, 1.5], [2, 1.5, 0.0]])
    ab, ba = divergence(a, b, cost), divergence(b, a, cost)
    assert np.isfinite(ab).all() and np.allclose(ab, ba) and (ab > 0).all()
    assert np.allclose(divergence(a, a, cost), 0, atol=1e-9)
    one_by_one = [divergence(a[i : i + 1], b[i : i + 1], cost)[0] for i in range(2)]
    assert np.allclose(ab, one_by_one, atol=1e-12)


def test_plan_relation_keeps_the_simplex(spark):
    ep = spark.createDataFrame([("r", "p1", [0.5, 0.5, 0.0], [0.2, 0.3, 0.5]), ("r", "p2", [0.1, 0.2, 0.7], [0.7, 0.2, 0.1])], "relation_id string, patient_id string, x array<double>, y array<double>")
    cost = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(3) for j in range(3)], "i int, j int, cost double")
    filled = estimate.filled_templates(estimate.gated_templates(ep, cost), ["relation_id"], 3)
    assert quality.bad_relations(estimate.template_entries(filled, 3)).count() == 0
    broken = estimate.template_entries(filled, 3).withColumn("value", F.when(F.col("entry_type") == "A", F.col("value") * 0.9).otherwise(F.col("value")))
    assert quality.bad_relations(broken).count() > 0


def test_tensor_programs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(12):
        t = rng.dirichlet(np.ones(3), size=2)
        rows.append((f"p{i}", t[:, :2], t[:, 2], [0.0, 0.0]))
    entries = spark.createDataFrame(entries_of(rows), ENTRY_SCHEMA)
    fitted = programs.decompose(entries, [(1, 1, 1), (2, 2, 2), (2, 9, 2)], 2, 2)
    diag = programs.rank_diagnostics(spark, fitted)
    best = {r.rank_patient: r.relative_error for r in programs.best_restarts(diag).collect()}
    assert best[2] < best[1] < 1.0
    assert [r.rank_source for r in programs.failed_ranks(diag).collect()] == [9]
    chosen = [("r", 2, 2, 2, next(r.restart_id for r in programs.best_restarts(diag).collect() if r.rank_patient == 2))]
    patient, source, target, core = programs.factor_tables(spark, fitted, chosen)
    sums = [programs.factor_sums(f) for f in (patient, source, target)]
    table = programs.program_table(programs.normalized_core(core, *sums))
    s, t = (programs.normalized_factor(f, m) for f, m in zip((source, target), sums[1:]))
    per_program = programs.program_entries(table, s, t, 2).groupBy("program_id").count().collect()
    assert len(per_program) == 8 and {r["count"] for r in per_program} == {6}


@pytest.mark.parametrize("rows_per_key", [2048, 3])
def test_pairs_of_large_blocks_are_spread_and_complete(spark, monkeypatch, rows_per_key):
    monkeypatch.setattr(pairing, "BLOCK_ROWS", rows_per_key)
    sizes = {0: (1, 40), 1: (25, 1), 2: (1, 1), 3: (5, 7)}
    made = [("r", "p", b, side, f"{side}{b}_{i}", "t", "d") for b, two in sizes.items() for side, n in zip(("source", "target"), two) for i in range(n)]
    blocks = spark.createDataFrame(made, "relation_id string, patient_id string, subbag_index int, side string, fov_id string, timepoint string, domain_label string")
    vectors = blocks.select("patient_id", "timepoint", "fov_id", "domain_label", F.array(F.xxhash64("fov_id").cast("double")).alias("fractions"))
    got = [(r.subbag_index, r.source_fov_id, r.target_fov_id) for r in pairing.block_pairs(blocks, vectors).collect()]
    want = {(b, f"source{b}_{i}", f"target{b}_{j}") for b, (n, m) in sizes.items() for i in range(n) for j in range(m)}
    assert len(got) == len(want) and set(got) == want
