"""Fitting patient relations: optimiser state as rows beside the pairs, relations meet in their mean.

One objective per relation over all patients and all their pairs. Patients of a relation are
coupled by the cohort mean only, and only that reaches the driver: an update is one job over
packs of patients that hold their pairs, dual potentials (which start the next transport), the
free parameters and both moments. Packs are dealt once, as many partitions as cores, and an
update is a stage of as many tasks without a shuffle or a plan: the driver keeps a record of
every task and plan, and hundreds of updates of many tasks filled it. A patient with too many
pairs for one row is cut into parts whose sums meet in a Spark aggregation before each update.

Packs stay cached between updates and are written below the shared folder every few updates;
a lost executor costs the updates of its packs since then. All patients move in step. Several
updates per job with a guessed course of the mean, repeated until the course agrees, give the
same result, but take as many passes as updates, as the pull to the mean is strong.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.operators.estimate import relation_rows, vsum
from fovea.operators.kernels import (
    COHORT_SCALE, GEOMETRY_WEIGHT, MAIN_RATE, MAIN_STEPS, MIN_MAIN_STEPS, PLATEAU_CHANGE, PLATEAU_STEPS, SCALE_FLOOR, WARMUP_RATE, WARMUP_STEPS,
    _from_sums, _pair_sums, _pair_terms, balanced_potentials, pair_divergences, start_relation, together,
)
from fovea.runtime import checkpoint_below, drop_stages, spread, write_stage
from fovea.schema import REL_PATIENT

#: Pairs in one row (256 bytes each); a patient with more is cut into parts.
PART_PAIRS = 65_536
#: Pairs in one partition; more of them than cores where there are more pairs.
TASK_PAIRS = 1_000_000
#: Updates between two written states.
ROUND_STEPS = 20
#: Status of a patient whose pairs cannot be fitted, and of one whose fit did not stay finite.
OK, BAD_PAIRS, NOT_FINITE = "ok", "invalid_pairs", "not_finite"
SIMPLEX_TOL = 1e-8

_STATE = "relation_id string, patient_id string, part int, n_parts int, weights binary, q binary, b binary, own binary, duals binary, params binary, sums binary"
_FIELDS = [f.split(" ")[0] for f in _STATE.split(", ")]
_TYPES = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (f.split(" ") for f in _STATE.split(", "))])


@dataclass
class Fit:
    """Fitted relations. ``entries``: relation rows; ``ledger``: one row per patient with its status and terms."""

    entries: DataFrame
    ledger: DataFrame
    history: list[dict]


@dataclass
class _Task:
    """What a task needs besides the rows: relation-sized numbers only."""

    k: int
    cost: np.ndarray
    scale: dict[str, float]
    i: int  # number of the update
    mean: dict[str, np.ndarray]  # mean parameters [t | e] before it
    done: frozenset[str] = frozenset()  # relations at their ends


def _rate(i: int) -> float:
    done = min(max(i - 1 - WARMUP_STEPS, 0) / MAIN_STEPS, 1.0)
    return WARMUP_RATE if i <= WARMUP_STEPS else MAIN_RATE * 0.5 * (1.0 + np.cos(np.pi * done))


def _values(logits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """[A | d] and e per patient from the flat free parameters."""
    free = logits[:, : k * (k + 1)].reshape(-1, k, k + 1)
    ez = np.exp(free - free.max(2, keepdims=True))
    return ez / ez.sum(2, keepdims=True), 1.0 / (1.0 + np.exp(-logits[:, k * (k + 1) :]))


def _terms(fit: np.ndarray, t: np.ndarray, e: np.ndarray, mean_t: np.ndarray, mean_e: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    """Terms of the objective per patient."""
    k = e.shape[1]
    opened = t[:, :, -1].mean(1) + e.mean(1)
    geometry = (t[:, :, :-1] * cost).sum((1, 2)) / k
    apart = ((t - mean_t) ** 2).sum(2).mean(1) + ((e - mean_e) ** 2).mean(1)
    return {"open": opened, "geometry": geometry, "recurrence": apart, "objective": (fit + (opened + GEOMETRY_WEIGHT * geometry) / 2 + apart / COHORT_SCALE) / 3}


def _gradient(gt: np.ndarray, ge: np.ndarray, t: np.ndarray, e: np.ndarray, mean_t: np.ndarray, mean_e: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Gradient of the objective in the free parameters, from that of the fit term in [A | d] and e."""
    k = e.shape[1]
    gt = gt + 2.0 * (t - mean_t) / k / COHORT_SCALE
    gt[:, :, :-1] += GEOMETRY_WEIGHT * cost / k / 2
    gt[:, :, -1] += 0.5 / k
    ge = ge + 0.5 / k + 2.0 * (e - mean_e) / k / COHORT_SCALE
    return np.hstack([(t * (gt - (gt * t).sum(2, keepdims=True)) / 3).reshape(len(t), -1), ge * e * (1 - e) / 3])


class _Rows:
    """Some patients (or parts) as arrays: pairs one below the other, parameters per row."""

    def __init__(self, rows: list[dict], task: _Task):
        k = task.k
        self.rows, self.task = rows, task
        get = lambda name, width: np.concatenate([np.frombuffer(r[name]).reshape(-1, width) for r in rows])
        self.q, self.b, self.own, self.weights = get("q", k), get("b", k), get("own", 1)[:, 0], get("weights", 1)[:, 0]
        sizes = [len(r["own"]) // 8 for r in rows]
        self.who = np.repeat(np.arange(len(rows)), sizes)
        self.ends = np.cumsum(sizes)[:-1]
        self.params = np.stack([np.frombuffer(r["params"]).reshape(3, -1) for r in rows], 1).copy()
        self.relation = [r["relation_id"] for r in rows]
        self.scale = np.array([task.scale[r] for r in self.relation])
        warm = None if rows[0]["duals"] is None else get("duals", 4 * k)
        self.duals = None if warm is None else [warm[:, i * k : (i + 1) * k].copy() for i in range(4)]
        self.before = None  # free parameters before the last update

    def pair_sums(self) -> np.ndarray:
        """What a step adds up over the pairs of every row; moves the dual potentials along."""
        k = self.task.k
        t, e = _values(self.params[0], k)
        sums = np.zeros((len(self.rows), 2 + 2 * (k * k + k)))
        duals: list[list[np.ndarray]] = [[], [], [], []]
        most = together(k)
        for lo in range(0, len(self.who), most):
            at = slice(lo, lo + most)
            who = self.who[at]
            warm = (None, None) if self.duals is None else ((self.duals[0][at], self.duals[1][at]), (self.duals[2][at], self.duals[3][at]))
            loss, draw, (cross, own) = _pair_terms(self.q[at], self.b[at], self.own[at], t[who], e[who], self.task.cost, self.scale[who], warm)
            for out, d in zip(duals, (*cross, *own)):
                out.append(d)
            first = np.flatnonzero(np.diff(who, prepend=-1))  # rows lie one below the other
            sums[who[first]] += np.add.reduceat(_pair_sums(self.q[at], self.weights[at], loss, draw), first)
        self.duals = [np.concatenate(d) for d in duals]
        return sums

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        k = self.task.k
        mean = np.stack([self.task.mean[r] for r in self.relation])
        return mean[:, : k * (k + 1)].reshape(-1, k, k + 1), mean[:, k * (k + 1) :]

    def update(self, sums: np.ndarray) -> np.ndarray:
        """One update of all rows; the objective before it."""
        k, i = self.task.k, self.task.i
        t, e = _values(self.params[0], k)
        mean_t, mean_e = self.means()
        fit, gt, ge = _from_sums(sums, k)
        g = _gradient(gt, ge, t, e, mean_t, mean_e, self.task.cost)
        logits, m, v = self.params
        self.before = logits.copy()
        m[:] = 0.9 * m + 0.1 * g
        v[:] = 0.999 * v + 0.001 * g**2
        logits -= _rate(i) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        return _terms(fit, t, e, mean_t, mean_e, self.task.cost)["objective"]

    def packed(self) -> "_Rows":
        """Without what the arrays hold already: as it lies between two updates."""
        self.rows, self.task = [{n: r[n] for n in (*REL_PATIENT, "part")} for r in self.rows], None
        return self

    def end(self) -> None:
        """The plateau is seen after an update: what counts is the state before it."""
        if self.before is not None:
            self.params[0], self.before = self.before, None

    def flat(self) -> np.ndarray:
        t, e = _values(self.params[0], self.task.k)
        return np.hstack([t.reshape(len(t), -1), e])

    def written(self, sums: np.ndarray | None = None) -> pa.RecordBatch:
        duals = np.split(np.hstack(self.duals), self.ends)
        new = [
            row | {"duals": d.tobytes(), "params": self.params[:, i].tobytes(), "sums": None if sums is None else sums[i].tobytes()}
            for i, (row, d) in enumerate(zip(self.rows, duals))
        ]
        return pa.RecordBatch.from_pylist(new, schema=_TYPES)


def _chunks(rows, task: _Task):
    """Rows one after the other, as many at a time as make up one chunk of pairs."""
    found, size, most = [], 0, together(task.k)
    for row in rows:
        n = len(row["own"]) // 8
        if found and (size + n > most or (found[0]["duals"] is None) != (row["duals"] is None)):
            yield _Rows(found, task)
            found, size = [], 0
        found.append(row)
        size += n
    if found:
        yield _Rows(found, task)


def _grouped(batches, task: _Task):
    """Rows of a task, as many at a time as make up one chunk of pairs."""
    return _chunks((row for batch in batches for row in batch.to_pylist()), task)


class _Totals:
    """Parameters after an update and objectives before it, summed per relation over the rows of a task."""

    def __init__(self):
        self.sums: dict[str, np.ndarray] = {}

    def add(self, rows: _Rows, value: np.ndarray) -> None:
        for row, one in zip(rows.rows, np.hstack([rows.flat(), value[:, None]])):
            if row["part"] == 0:
                self.sums[row["relation_id"]] = self.sums.get(row["relation_id"], 0.0) + one

    def written(self):
        if self.sums:
            empty = {n: None for n in _FIELDS}
            yield pa.RecordBatch.from_pylist([empty | {"relation_id": r, "part": -1, "sums": x.tobytes()} for r, x in self.sums.items()], schema=_TYPES)


def _updated(state: DataFrame, task: _Task) -> list[DataFrame]:
    """Frames to cache; the last one is the state after one update, and rows with the sums of every task."""

    def run(batches):
        totals = _Totals()
        for rows in _grouped(batches, task):
            totals.add(rows, rows.update(rows.pair_sums()))
            yield rows.written()
        yield from totals.written()

    return [state.mapInArrow(run, _STATE).persist()]


def _updated_parts(state: DataFrame, task: _Task) -> list[DataFrame]:
    """As ``_updated``, for patients in parts: their sums meet before the update."""

    def partial(batches):
        for rows in _grouped(batches, task):
            yield rows.written(rows.pair_sums())

    def whole(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        return table.select(REL_PATIENT).slice(0, 1).append_column("total", pa.array([total.tobytes()], pa.binary()))

    def run(batches):
        totals = _Totals()
        for batch in batches:
            rows = _Rows(batch.select(_FIELDS).to_pylist(), task)
            totals.add(rows, rows.update(np.stack([np.frombuffer(s) for s in batch.column("total").to_pylist()])))
            yield rows.written()
        yield from totals.written()

    summed = state.mapInArrow(partial, _STATE).persist()
    # written: a plan that holds the rows and their totals would double with every update
    total = write_stage(summed.select(*REL_PATIENT, "sums").groupBy(*REL_PATIENT).applyInArrow(whole, "relation_id string, patient_id string, total binary"), "totals")
    return [summed, summed.join(total, REL_PATIENT).mapInArrow(run, _STATE).persist()]


def _sound(n_states: int):
    """Is a pair made of two distributions over the states?"""
    one = lambda c: (F.size(F.col(c)) == n_states) & F.forall(F.col(c), lambda x: x.isNotNull() & (x >= 0) & (x <= 1 + SIMPLEX_TOL)) & (F.abs(vsum(F.col(c)) - 1) <= SIMPLEX_TOL)
    return F.coalesce(one("a") & one("b"), F.lit(False))


def packed_pairs(pairs: DataFrame, cost: np.ndarray, n_states: int, part_pairs: int = PART_PAIRS) -> DataFrame:
    """Staged start state: one row per patient, or per part of it, with its pairs and their weights.

    A weight balances the blocks of a patient. Pairs of equal patients are spread over parts
    by the hash of the pair.
    """
    k, block = n_states, [*REL_PATIENT, "subbag_index"]
    per_block = pairs.groupBy(*block).agg(F.count(F.lit(1)).alias("n_block"))
    per_patient = per_block.groupBy(*REL_PATIENT).agg(F.count(F.lit(1)).alias("n_blocks"), F.ceil(F.sum("n_block") / part_pairs).cast("int").alias("n_parts"))
    rows = pairs.join(per_block.hint("merge"), block).join(per_patient, REL_PATIENT).select(
        *REL_PATIENT, F.pmod(F.xxhash64("pair_id"), F.col("n_parts")).cast("int").alias("part"), "n_parts", (1.0 / (F.col("n_block") * F.col("n_blocks"))).alias("weight"), "a", "b", "pair_id"
    )
    t0, e0 = start_relation(k)
    start = np.zeros((3, k * (k + 2)))
    start[0] = np.concatenate([np.log(np.maximum(t0, 1e-12)).ravel(), np.log(np.maximum(e0, 1e-12) / np.maximum(1 - e0, 1e-12))])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pair_id")
        matrix = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
        b, own, most = matrix("b"), [], together(k)
        for lo in range(0, len(b), most):
            g, h = balanced_potentials(b[lo : lo + most], b[lo : lo + most], cost)
            own.append(0.5 * ((g + h) * b[lo : lo + most]).sum(1))
        first = table.select([*REL_PATIENT, "part", "n_parts"]).slice(0, 1).to_pylist()[0]
        data = {"weights": table.column("weight").to_numpy(), "q": matrix("a"), "b": b, "own": np.concatenate(own), "params": start}
        return pa.Table.from_pylist([first | {n: np.ascontiguousarray(x).tobytes() for n, x in data.items()} | {"duals": None, "sums": None}], schema=_TYPES)

    grouped = spread(rows, *REL_PATIENT, "part").groupBy(*REL_PATIENT, "part").applyInArrow(pack, _STATE)
    return write_stage(grouped, "fit")


@dataclass
class _Course:
    """What the driver knows of a relation: how many patients, their mean, the plateau."""

    size: int
    mean: np.ndarray
    before: float = np.inf
    calm: int = 0
    done: bool = False

    def settle(self, i: int, sums: np.ndarray) -> None:
        """Takes over update ``i`` from the sums over all patients, unless the plateau was reached before it."""
        now = float(sums[-1]) / self.size
        late = i >= WARMUP_STEPS + MIN_MAIN_STEPS
        self.calm = self.calm + 1 if late and abs(self.before - now) <= PLATEAU_CHANGE else 0
        self.before, self.done = now, self.calm >= PLATEAU_STEPS
        if not self.done:
            self.mean = sums[:-1] / self.size


def _dealt(state: DataFrame, n_pairs: int) -> DataFrame:
    """Rows of a relation dealt over the cores back and forth by size, as every update waits for the slowest of them."""
    cores = state.sparkSession.sparkContext.defaultParallelism
    width = cores * -(-n_pairs // (cores * TASK_PAIRS))
    size = F.length("own")
    place = F.row_number().over(Window.partitionBy("relation_id").orderBy(F.col("size").desc(), "patient_id")) - 1
    turn, at = F.floor(place / width), place % width
    to = F.when(turn % 2 == 0, at).otherwise(width - 1 - at) + F.hash("relation_id")
    keys = state.select(*REL_PATIENT, size.alias("size")).select(*REL_PATIENT, F.pmod(to, F.lit(width)).cast("int").alias("to"))
    return state.join(keys, REL_PATIENT).repartitionById(width, F.col("to")).drop("to")


def _relation_sums(after: RDD) -> dict[str, np.ndarray]:
    sums: dict[str, np.ndarray] = {}
    for one in after.mapPartitions(lambda packs: [p for p in packs if isinstance(p, dict)]).collect():
        for r, x in one.items():
            sums[r] = sums.get(r, 0.0) + x
    return sums


def _fit_whole(state: DataFrame, task: _Task, courses: dict[str, _Course], rounds: int, steps: int, n_pairs: int) -> tuple[DataFrame, list[dict]]:
    """Updates of the relations of ``courses``, whose patients are rows; (their ends, mean objective after every round)."""

    def packs(rows):
        by_relation: dict[str, list[dict]] = {}
        for row in rows:
            by_relation.setdefault(row["relation_id"], []).append(row.asDict())
        for own in by_relation.values():
            yield from (rows.packed() for rows in _chunks(own, task))

    def update(task: _Task):
        def run(packs):
            totals = _Totals()
            for rows in packs:
                if isinstance(rows, dict):
                    continue
                if rows.relation[0] in task.done:
                    rows.end()
                else:
                    rows.task = task
                    totals.add(rows, rows.update(rows.pair_sums()))
                yield rows.packed()
            yield totals.sums

        return run

    def ends(packs):
        for rows in packs:
            if not isinstance(rows, dict):
                if rows.relation[0] in task.done:
                    rows.end()
                rows.task = task
                yield from _ends(rows).to_pylist()

    below = checkpoint_below(state.sparkSession)
    now, history, written = _dealt(state, n_pairs).rdd.mapPartitions(packs), [], []
    for i in range(1, rounds * steps + 1):
        live = {r: c for r, c in courses.items() if not c.done}
        if not live:
            break
        task.i, task.mean, task.done = i, {r: c.mean for r, c in live.items()}, frozenset(courses) - frozenset(live)
        after = now.mapPartitions(update(task)).persist(StorageLevel.MEMORY_AND_DISK)
        if i % steps == 0:
            after.checkpoint()
        sums = _relation_sums(after)
        for r, c in live.items():
            c.settle(i, sums[r])
        if i > 1:
            now.unpersist()
        now = after
        if after.isCheckpointed():
            drop_stages(state.sparkSession, written)
            written = [below(after)]
        if i % steps == 0 or all(c.done for c in courses.values()):
            history.append({r: c.before for r, c in courses.items()})
    task.mean, task.done = {r: c.mean for r, c in courses.items()}, frozenset(r for r, c in courses.items() if c.done)
    out = write_stage(state.sparkSession.createDataFrame(now.mapPartitions(ends), _ENDS), "ends")
    now.unpersist()
    drop_stages(state.sparkSession, written)
    return out, history


def _fit_relations(state: DataFrame, task: _Task, courses: dict[str, _Course], rounds: int, steps: int, in_parts: bool) -> tuple[DataFrame, list[dict]]:
    """Updates of the relations of ``courses``; (state at their ends, mean objective after every round)."""
    finished, history, cached = [], [], []
    for i in range(1, rounds * steps + 1):
        live = {r: c for r, c in courses.items() if not c.done}
        if not live:
            break
        task.i, task.mean = i, {r: c.mean for r, c in live.items()}
        cached += (_updated_parts if in_parts else _updated)(state, task)
        after = cached[-1]
        sums: dict[str, np.ndarray] = {}
        for r in sorted(after.where("part = -1").select("relation_id", "sums").collect()):
            sums[r["relation_id"]] = sums.get(r["relation_id"], 0.0) + np.frombuffer(r["sums"])
        for r, c in live.items():
            c.settle(i, sums[r])
        over = [r for r, c in live.items() if c.done]
        if over:  # the plateau is seen after the update: what counts is the state before it
            finished.append(write_stage(state.where(F.col("relation_id").isin(over)), "fit"))
        new = after.where("part >= 0")
        if over:
            new = new.where(~F.col("relation_id").isin(over))
        if i % steps == 0 or over:
            new = write_stage(new, "fit")
            while cached:
                cached.pop().unpersist()
        while len(cached) > 4:
            cached.pop(0).unpersist()
        if i % steps == 0 or all(c.done for c in courses.values()):
            history.append({r: c.before for r, c in courses.items()})
        state = new
    for part in finished:
        state = state.unionByName(part)
    return state, history


#: Of a patient, or a part of it, at the fitted relation: what its pairs add up to, other terms of the objective, the relation.
_ENDS = "relation_id string, patient_id string, n_pairs long, mean double, square double, open double, geometry double, recurrence double, t array<double>, e array<double>"


def _ends(rows: _Rows) -> pa.RecordBatch:
    sums = rows.pair_sums()
    t, e = _values(rows.params[0], rows.task.k)
    mean_t, mean_e = rows.means()
    extra = _terms(np.zeros(len(sums)), t, e, mean_t, mean_e, rows.task.cost)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows.relation), pa.array([r["patient_id"] for r in rows.rows]), pa.array(np.bincount(rows.who, minlength=len(sums))),
            pa.array(sums[:, 0]), pa.array(sums[:, 1]), *(pa.array(extra[n]) for n in ("open", "geometry", "recurrence")),
            pa.array(t.reshape(len(t), -1).tolist(), pa.list_(pa.float64())), pa.array(e.tolist(), pa.list_(pa.float64())),
        ],
        names=[f.split(" ")[0] for f in _ENDS.split(", ")],
    )


def _state_ends(state: DataFrame, task: _Task) -> DataFrame:
    return state.mapInArrow(lambda batches: (_ends(rows) for rows in _grouped(batches, task)), _ENDS)


def _ledger(parts: DataFrame) -> DataFrame:
    """Terms of the objective per patient at the fitted relation, and the relation."""
    whole = parts.groupBy(*REL_PATIENT).agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum("mean").alias("observation"), (F.sum("square") - F.sum("mean") ** 2).alias("consistency"),
        *(F.first(c).alias(c) for c in ("open", "geometry", "recurrence", "t", "e")),
    )
    prior = (F.col("open") + GEOMETRY_WEIGHT * F.col("geometry")) / 2
    total = (F.col("observation") + F.col("consistency") + prior + F.col("recurrence") / COHORT_SCALE) / 3
    finite = F.coalesce(F.abs(total) < F.lit(float("inf")), F.lit(False))
    return whole.withColumn("objective", total).withColumn("status", F.when(finite, OK).otherwise(NOT_FINITE))


def fit_relations(
    pairs: DataFrame, cost: np.ndarray, n_states: int, rounds: int = (WARMUP_STEPS + MAIN_STEPS) // ROUND_STEPS, steps: int = ROUND_STEPS, part_pairs: int = PART_PAIRS
) -> Fit:
    """Relations of every patient from its FOV pairs.

    The rate follows the fixed schedule over ``rounds * steps`` updates; a relation is done
    when it reaches the plateau. A patient with a pair that is not made of two distributions
    is left out before the fit and listed in the ledger, so that it cannot spoil the mean of
    the others.
    """
    k = n_states
    checked = pairs.withColumn("__sound", _sound(k))
    bad = checked.where(~F.col("__sound")).select(*REL_PATIENT).distinct()
    sound = pairs.join(bad, REL_PATIENT, "left_anti") if not bad.isEmpty() else pairs
    state = packed_pairs(sound, cost, k, part_pairs)
    reference = pair_divergences(sound.select("relation_id", "pair_id", "a", "b"), cost)
    scale = {r["relation_id"]: max(r["m"], SCALE_FLOOR) for r in reference.groupBy("relation_id").agg(F.avg("cost").alias("m")).collect()}
    sizes = state.groupBy("relation_id").agg(F.count_if(F.col("part") == 0).alias("n"), F.max("n_parts").alias("parts"), F.sum(F.length("own") / 8).cast("long").alias("pairs")).collect()
    t0, e0 = start_relation(k)
    start = np.concatenate([t0.ravel(), e0])
    courses = {r["relation_id"]: _Course(r["n"], start) for r in sizes}
    split = [r["relation_id"] for r in sizes if r["parts"] > 1]

    fitted, history = [], [{} for _ in range(rounds)]
    for in_parts, own in ((False, [r for r in courses if r not in split]), (True, split)):
        if own:
            task = _Task(k, cost, scale, 1, {})
            mine, theirs = state.where(F.col("relation_id").isin(own)), {r: courses[r] for r in own}
            if in_parts:
                out, past = _fit_relations(mine, task, theirs, rounds, steps, in_parts)
                out = _state_ends(out, _Task(k, cost, scale, 1, {r: c.mean for r, c in theirs.items()}))
            else:
                out, past = _fit_whole(mine, task, theirs, rounds, steps, sum(r["pairs"] for r in sizes if r["relation_id"] in own))
            fitted.append(out)
            for done, more in zip(history, past):
                done.update(more)
    if not fitted:
        fitted = [_state_ends(state, _Task(k, cost, scale, 1, {}))]
    whole = _ledger(fitted[0] if len(fitted) == 1 else fitted[0].unionByName(fitted[1]))
    ledger = whole.drop("t", "e").unionByName(bad.withColumn("status", F.lit(BAD_PAIRS)), allowMissingColumns=True)
    return Fit(relation_rows(REL_PATIENT, states_of(whole, k), k), ledger, [h for h in history if h])


def states_of(relation: DataFrame, n_states: int) -> DataFrame:
    """Array form of a relation: (state_id, a, d, e) rows from the flat ``t`` and ``e`` arrays."""
    k1 = n_states + 1
    rows = relation.select(*REL_PATIENT, "t", "e", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("state_id"))
    return rows.select(
        *REL_PATIENT, "state_id", F.slice("t", F.col("state_id") * k1 + 1, n_states).alias("a"),
        F.get("t", F.col("state_id") * k1 + n_states).alias("d"), F.get("e", F.col("state_id")).alias("e"),
    )
