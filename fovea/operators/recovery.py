"""Profile metrics and recovery errors of estimated relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.functions.ranks import exact_median
from fovea.operators.estimate import pack_relations, vsum
from fovea.operators.states import js_divergence
from fovea.schema import MASS_TOL

# Fixed value: share of the open mass a support set must cover.
COVERAGE = 0.95


def unit_mass(v: Column) -> Column:
    """The array divided by its sum."""
    return F.zip_with(v, F.array_repeat(vsum(v), F.size(v)), lambda t, total: t / total)


def _mean(v: Column) -> Column:
    return vsum(v) / F.size(v)


def _gaps(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; null when either is constant."""
    centred = lambda v: F.zip_with(v, F.array_repeat(_mean(v), F.size(v)), lambda t, m: t - m)
    ca, cb = centred(a), centred(b)
    dot = lambda u, v: vsum(F.zip_with(u, v, lambda p, q: p * q))
    flat = (F.array_max(F.transform(ca, F.abs)) <= 1e-12) | (F.array_max(F.transform(cb, F.abs)) <= 1e-12)
    scale = F.sqrt(dot(ca, ca) * dot(cb, cb))
    return F.greatest(F.least(dot(ca, cb) / F.when(~flat, scale), F.lit(1.0)), F.lit(-1.0))


def profile_metrics(df: DataFrame, left: str, right: str, prefix: str = "") -> DataFrame:
    """Pearson, MAE, MSE and JS of two normalised profiles, added as columns."""
    a, b = unit_mass(F.col(left)), unit_mass(F.col(right))
    base = df.withColumn("_a", a).withColumn("_b", b)
    gap = _gaps(F.col("_a"), F.col("_b"))
    kl = vsum(F.zip_with("_a", "_b", lambda u, v: F.when((u > 0) & (v > 0), u * F.log(u / v)).otherwise(0.0)))
    supported = ~F.exists(F.arrays_zip("_a", "_b"), lambda p: (p["_a"] > 0) & (p["_b"] <= 0))
    return base.select(
        *df.columns,
        pearson(F.col("_a"), F.col("_b")).alias(f"{prefix}pearson"),
        _mean(F.transform(gap, F.abs)).alias(f"{prefix}mae"),
        _mean(F.transform(gap, lambda g: g * g)).alias(f"{prefix}mse"),
        js_divergence(F.col("_a"), F.col("_b")).alias(f"{prefix}js_divergence"),
        F.when(supported, kl).alias(f"{prefix}kl_divergence"),
    )


def mean_profiles(rows: DataFrame, scope: list[str], column: str, n_states: int, alias: str) -> DataFrame:
    """Average of array profiles per scope, renormalised to unit mass."""
    means = rows.groupBy(*scope).agg(F.array(*[F.avg(F.get(column, F.lit(k))) for k in range(n_states)]).alias("_m"))
    return means.select(*scope, unit_mass(F.col("_m")).alias(alias))


def deviation_from_centroid(rows: DataFrame, scope: list[str], column: str, n_states: int) -> DataFrame:
    """Median total-variation distance of the profiles from their centroid."""
    unit = rows.withColumn("_p", unit_mass(F.col(column)))
    centres = mean_profiles(unit, scope, "_p", n_states, "_c")
    tv = vsum(F.transform(_gaps(F.col("_p"), F.col("_c")), F.abs)) / 2
    distances = unit.join(centres, scope).select(*scope, tv.alias("tv"))
    return exact_median(distances, scope, "tv", "median_tv_deviation", low=0.0, high=1.0)


def project_profiles(rows: DataFrame, column: str, identities: DataFrame, alias: str) -> DataFrame:
    """Profile times the state identity vectors (state-sized, one array of arrays)."""
    listed = F.array_sort(F.collect_list(F.struct("state_id", "identity")))
    one = identities.agg(F.transform(listed, lambda s: s["identity"]).alias("_g")).withColumn("_one", F.lit(1))
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    width = F.sequence(F.lit(0), F.size(F.get("_g", F.lit(0))) - 1)
    out = F.transform(width, lambda t: vsum(F.zip_with(F.col(column), F.col("_g"), lambda w, g: w * F.get(g, t))))
    return joined.withColumn(alias, out).drop("_g", "_one")


# --- support sets ------------------------------------------------------------


def _ranked(values: Column) -> Column:
    """Indices by value, highest first, ties to the lower index."""
    return F.transform(
        F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), lambda s: s["i"]
    )


def coverage_support(values: Column) -> Column:
    """Smallest index set holding the required share of the mass."""
    total = vsum(values)
    start = F.struct(F.lit(0.0).alias("covered"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, i: Column) -> Column:
        take = acc["covered"] < COVERAGE - 1e-12
        return F.struct(
            F.when(take, acc["covered"] + F.get(values, i) / total).otherwise(acc["covered"]).alias("covered"),
            F.when(take, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.when(total > MASS_TOL, F.aggregate(_ranked(values), start, step, lambda acc: acc["kept"])).otherwise(F.array().cast("array<int>"))


def set_f1(a: Column, b: Column) -> Column:
    hit = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when(hit == 0, 0.0)
        .otherwise(2.0 * hit / (F.size(a) + F.size(b)))
    )


def _target_scores(matrix: Column, x: Column) -> Column:
    """Incoming off-diagonal mass of every target state."""
    axis = F.sequence(F.lit(0), F.size(x) - 1)

    def score(j: Column) -> Column:
        rows = F.transform(matrix, lambda row, i: F.when(i == j, 0.0).otherwise(F.get(row, j) * F.get(x, i)))
        return vsum(rows)

    return F.transform(axis, score)


def target_recall(x: Column, truth: Column, estimate: Column) -> Column:
    """Share of the true off-diagonal targets among the same number of top predicted ones."""
    true_scores = _target_scores(truth, x)
    hits = F.filter(F.transform(true_scores, lambda v, i: F.when(v > MASS_TOL, i)), lambda i: i.isNotNull())
    k = F.size(hits)
    top = F.slice(_ranked(_target_scores(estimate, x)), F.lit(1), F.greatest(k, F.lit(1)))
    return F.size(F.array_intersect(hits, top)) / F.when(k > 0, k)


# --- recovery errors ---------------------------------------------------------

OPEN_METRICS = ["open_support_f1", "d_mae", "d_mse", "e_mae", "e_mse"]
MASS_METRICS = [
    "f_l1_total", "g_l1_total", "e_l1_total", "offdiag_mass_abs_error", "depletion_mass_abs_error",
    "emergence_mass_abs_error", "offdiag_ratio", "depletion_capture", "emergence_capture", "endpoint_y_mae",
    "a_mae_active", "a_mse_active", "target_recall_at_k", *OPEN_METRICS,
]


def pack_recovery(truth: DataFrame, estimate: DataFrame, endpoints: DataFrame, key: list[str], method_key: list[str], n_states: int) -> DataFrame:
    """Truth and estimate side by side, one row per (key, method); missing estimates stay null."""
    t = pack_relations(truth, key, n_states).toDF(*key, "at", "dt", "et").join(endpoints.select(*key, "x", "y"), key)
    e = pack_relations(estimate, [*key, *method_key], n_states).toDF(*key, *method_key, "ah", "dh", "eh")
    return t.join(e, key)


def recovery_wide(packed: DataFrame) -> DataFrame:
    """All recovery metrics of a packed row, row-local."""
    scaled = lambda m: F.zip_with(m, "x", lambda row, x: F.transform(row, lambda v: v * x))
    times = lambda v: F.zip_with(v, "x", lambda a, x: a * x)
    base = (
        packed.withColumn("ft", scaled("at")).withColumn("fh", scaled("ah"))
        .withColumn("gt", times("dt")).withColumn("gh", times("dh"))
        .withColumn("fgap", F.zip_with("fh", "ft", lambda a, b: F.zip_with(a, b, lambda u, v: u - v)))
    )
    off = lambda m: vsum(F.transform(m, lambda row, i: vsum(row) - F.get(row, i)))
    l1 = lambda v: vsum(F.transform(v, F.abs))
    l2 = lambda v: vsum(F.transform(v, lambda t: t * t))
    ggap, egap = _gaps(F.col("gh"), F.col("gt")), _gaps(F.col("eh"), F.col("et"))
    k = F.size("x")
    ratio = lambda a, b: a / F.when(b > MASS_TOL, b)
    axis = F.sequence(F.lit(0), k - 1)
    raw_end = F.transform(axis, lambda j: vsum(F.transform("fh", lambda row: F.get(row, j))) + F.get("eh", j))
    base = base.withColumn("endpoint", raw_end)
    end_gap = F.zip_with("endpoint", "y", lambda p, y: y - p / vsum(F.col("endpoint")))
    active = F.filter(F.zip_with("fgap", "x", lambda g, x: F.when(x > MASS_TOL, g)), lambda g: g.isNotNull())
    n_active = F.size(active) * k
    mean_active = lambda fn: F.when(n_active > 0, fn(F.flatten(active)) / n_active).otherwise(0.0)
    f1 = (set_f1(coverage_support(F.col("gt")), coverage_support(F.col("gh"))) + set_f1(coverage_support(F.col("et")), coverage_support(F.col("eh")))) / 2
    values = {
        "f_l1_total": l1(F.flatten("fgap")),
        "g_l1_total": l1(ggap),
        "e_l1_total": l1(egap),
        "offdiag_mass_abs_error": F.abs(off(F.col("fh")) - off(F.col("ft"))),
        "depletion_mass_abs_error": F.abs(vsum(F.col("gh")) - vsum(F.col("gt"))),
        "emergence_mass_abs_error": F.abs(vsum(F.col("eh")) - vsum(F.col("et"))),
        "offdiag_ratio": ratio(off(F.col("fh")), off(F.col("ft"))),
        "depletion_capture": ratio(vsum(F.col("gh")), vsum(F.col("gt"))),
        "emergence_capture": ratio(vsum(F.col("eh")), vsum(F.col("et"))),
        "endpoint_y_mae": _mean(F.transform(end_gap, F.abs)),
        "a_mae_active": mean_active(l1),
        "a_mse_active": mean_active(l2),
        "target_recall_at_k": target_recall(F.col("x"), F.col("at"), F.col("ah")),
        "open_support_f1": f1,
        "d_mae": l1(ggap) / k,
        "d_mse": l2(ggap) / k,
        "e_mae": l1(egap) / k,
        "e_mse": l2(egap) / k,
    }
    keys = [c for c in packed.columns if c not in ("at", "dt", "et", "ah", "dh", "eh", "x", "y")]
    return base.select(*keys, (vsum(F.col("gt")) + vsum(F.col("et"))).alias("open_mass"), *[v.alias(n) for n, v in values.items()])


def metric_rows(wide: DataFrame, names: list[str], open_only: bool = False) -> DataFrame:
    """Long metric rows with a status: reported, or not applicable when the value is undefined."""
    keys = [c for c in wide.columns if c not in MASS_METRICS and c != "open_mass"]

    def value(name: str) -> Column:
        if open_only and name == "open_support_f1":
            return F.when(F.col("open_mass") > MASS_TOL, F.col(name))
        return F.col(name)

    rows = wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric_name"), value(n).alias("value")) for n in names])))
    return rows.withColumn("status", F.when(F.col("value").isNull(), "not_applicable").otherwise("reported"))
