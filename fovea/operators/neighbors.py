"""Spatial neighbourhoods inside a FOV.

Exact k nearest neighbours with ties broken by cell id. Small FOVs are solved whole, many
in one kernel call. Large FOVs are cut into tiles along a space-filling curve; a tile gets
those cells of other tiles that can be a neighbour of one of its own, whatever the FOV's
size or density. More than k cells in one place are each other's neighbours, without tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.operators.resampling import draw
from fovea.runtime import durable
from fovea.schema import FOV_KEYS

SMALL_FOV = 96
#: Cells of a tile, and of the stretches of a tile that are searched together.
TILE, STRETCH = 4096, 128
#: Rows of small FOVs in one kernel call.
_ROWS = 1 << 15


def _finite(name: str) -> Column:
    """The coordinate, or an error if it is not a finite number."""
    value = F.col(name).cast("double")
    sound = F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))
    return F.when(sound, value).otherwise(F.raise_error(F.lit(f"{name} must be a finite number"))).alias(name)


def _first(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """([rows, k] values, places) of the k smallest of every row, equal ones by place; ``d`` is used up.

    What a row lacks has an infinite value.
    """
    rows = np.arange(len(d))
    value, place = np.full((len(d), k), np.inf), np.zeros((len(d), k), np.int64)
    for j in range(min(k, d.shape[1])):
        at = d.argmin(1)
        place[:, j], value[:, j] = at, d[rows, at]
        d[rows, at] = np.inf
    return value, place


def _near(value: np.ndarray, place: np.ndarray, ids: pa.Array | None, columns: dict[str, pa.Array]) -> pa.ListArray:
    """array<struct<dist2, neighbor_id, columns>> per row of :func:`_first`; without ``ids`` only the columns."""
    on = np.isfinite(value)
    at = pa.array(place[on])
    fields = {} if ids is None else {"dist2": pa.array(value[on]), "neighbor_id": ids.take(at)}
    fields |= {name: c.take(at) for name, c in columns.items()}
    offsets = np.concatenate([[0], np.cumsum(on.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _near_type(cells: DataFrame, columns: list[str], ids: bool) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    fields = [f"dist2: double, neighbor_id: {kinds['cell_id']}"] if ids else []
    return "array<struct<" + ", ".join([*fields, *(f"`{c}`: {kinds[c]}" for c in columns)]) + ">>"


def _declared(cells: DataFrame, names: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before; the first one does."""
    a, b = column[1:], column[:-1]
    differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
    return np.concatenate([[True], differs.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros(0, bool)


def _starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Rows at which a new group begins; the rows of a group follow each other."""
    new = np.zeros(batch.num_rows, bool)
    for name in names:
        new |= _differs(batch.column(batch.schema.get_field_index(name)))
    return np.flatnonzero(new)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _whole_fovs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut between FOVs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            rows = _joined(held)
            last = int(_starts(rows, FOV_KEYS)[-1])
            if last:
                yield rows.slice(0, last)
            held = [rows.slice(last)]
    if held:
        yield _joined(held)


def _small(cells: DataFrame, k: int, columns: list[str], ids: bool) -> DataFrame:
    """Neighbours for FOVs of at most ``SMALL_FOV`` cells: one shuffle, FOVs of one size in one kernel call."""

    def run(batches):
        for batch in _whole_fovs(batches):
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x, y = (column[c].to_numpy(zero_copy_only=False) for c in ("x", "y"))
            starts = _starts(batch, FOV_KEYS)
            sizes = np.diff(np.append(starts, batch.num_rows))
            same = np.cumsum(_differs(column["cell_id"]))
            value, place = np.full((batch.num_rows, k), np.inf), np.zeros((batch.num_rows, k), np.int64)
            for n in np.unique(sizes):
                of_size = starts[sizes == n]
                step = max(1, (1 << 20) // int(n * n))
                for lo in range(0, len(of_size), step):
                    at = of_size[lo : lo + step, None] + np.arange(n)
                    px, py, own = x[at], y[at], same[at]
                    d = (px[:, None, :] - px[:, :, None]) ** 2 + (py[:, None, :] - py[:, :, None]) ** 2
                    d[own[:, None, :] == own[:, :, None]] = np.inf
                    value[at.ravel()], near = _first(d.reshape(-1, n), k)
                    place[at.ravel()] = near + np.repeat(at[:, 0], n)[:, None]
            near = _near(value, place, column["cell_id"] if ids else None, {c: column[c] for c in columns})
            yield pa.RecordBatch.from_arrays([*(column[c] for c in (*FOV_KEYS, "cell_id")), near], names=[*FOV_KEYS, "cell_id", "near"])

    placed = cells.repartition(*FOV_KEYS).withColumn("_h", F.xxhash64(*FOV_KEYS)).sortWithinPartitions("_h", *FOV_KEYS, "cell_id").drop("_h")
    return placed.mapInArrow(run, f"{_declared(cells, [*FOV_KEYS, 'cell_id'])}, near {_near_type(cells, columns, ids)}")


def _places(cells: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """``here``: the first k + 1 cells of every place by id; more can be nobody's neighbour.

    The limit on the row number lets Spark cut every task's rows before the shuffle, so a
    crowded place does not travel as a whole.
    """
    place = [*FOV_KEYS, "x", "y"]
    order = Window.partitionBy(*place).orderBy("cell_id")
    first = cells.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    return first.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("cell_id", *columns))).alias("here"))


def _curve(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``z``: place of every point on the Morton curve through its FOV's bounding square."""

    def spread_bits(value: str, origin: str) -> Column:
        v = F.least(F.floor((F.col(value) - F.col(origin)) / F.col("span") * (1 << 30)), F.lit((1 << 30) - 1)).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    z = spread_bits("x", "x0").bitwiseOR(F.shiftleft(spread_bits("y", "y0"), 1))
    return points.join(boxes.select(*FOV_KEYS, "x0", "y0", "span"), FOV_KEYS).withColumn("z", z).drop("x0", "y0", "span")


class _Points:
    """Points in the order of their ids."""

    def __init__(self, ids: pa.Array, x: np.ndarray, y: np.ndarray):
        order = pc.sort_indices(ids)
        self.order = order.to_numpy(zero_copy_only=False).astype(np.int64)
        self.x, self.y = x[self.order], y[self.order]
        self.same = np.cumsum(_differs(ids.take(order)))
        #: by place in the input
        self.rank = np.empty(len(self.order), np.int64)
        self.rank[self.order] = np.arange(len(self.order))

    def _distance(self, asked: np.ndarray, among: np.ndarray) -> np.ndarray:
        d = (self.x[None, among] - self.x[asked, None]) ** 2 + (self.y[None, among] - self.y[asked, None]) ** 2
        d[self.same[None, among] == self.same[asked, None]] = np.inf
        return d

    def search(self, n_own: int, wanted: np.ndarray, k: int):
        """For every stretch of the first ``n_own`` points of the input: (asked points, values, places, box and reach).

        Values and places as in :func:`_first`, places by the input. The reach is the largest
        squared distance of a k-th neighbour, infinite if one is missing.
        """
        size = max(STRETCH, k + 2)
        for lo in range(0, n_own, size):
            asked = np.flatnonzero(wanted[lo : lo + size]) + lo
            if not len(asked):
                continue
            own = np.sort(self.rank[lo : min(lo + size, n_own)])
            at = self.rank[asked]
            box = x0, x1, y0, y1 = self.x[at].min(), self.x[at].max(), self.y[at].min(), self.y[at].max()
            bound = _first(self._distance(at, own), k)[0][:, -1].max()
            among = np.flatnonzero(_gap(self.x, self.y, box) <= bound)
            value, place = _first(self._distance(at, among), k)
            yield asked, value, self.order[among[place]], (x0, x1, y0, y1, value[:, -1].max())


def _gap(x: np.ndarray, y: np.ndarray, box) -> np.ndarray:
    """Squared distance of points from a box."""
    gx = np.maximum(np.maximum(box[0] - x, x - box[1]), 0)
    gy = np.maximum(np.maximum(box[2] - y, y - box[3]), 0)
    return gx * gx + gy * gy


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of one FOV and about ``TILE`` rows from rows in the order of FOVs and curve."""

    def emit(run: pa.RecordBatch):
        parts = max(1, round(run.num_rows / TILE))
        cuts = [run.num_rows * i // parts for i in range(parts + 1)]
        yield from (run.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < 4 * TILE:
            continue
        rows = _joined(held)
        starts = [*_starts(rows, FOV_KEYS).tolist(), rows.num_rows]
        for lo, hi in zip(starts[:-2], starts[1:-1]):
            yield from emit(rows.slice(lo, hi - lo))
        rest = rows.slice(starts[-2])
        while rest.num_rows >= 3 * TILE:
            yield rest.slice(0, TILE)
            rest = rest.slice(TILE)
        held = [rest]
    if held:
        rows = _joined(held)
        starts = [*_starts(rows, FOV_KEYS).tolist(), rows.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:]):
            yield from emit(rows.slice(lo, hi - lo))


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _tiled(places: DataFrame, boxes: DataFrame, k: int, columns: list[str], ids: bool) -> DataFrame:
    """Neighbours for the cells of large FOVs that share their place with less than k others.

    A tile finds the best neighbours among its own cells, which bounds how far each stretch of
    it has to look. Tiles within that reach send the cells inside it, and the tile searches
    again among its own and those. The lists of neighbours are never written.
    """
    kinds = {f.name: f.dataType.simpleString() for f in places.select(*FOV_KEYS, "x", "y", F.inline("here")).schema.fields}
    listed = ["cell_id", "x", "y", *columns]
    points = places.select(*FOV_KEYS, "x", "y", (F.size("here") <= k).alias("wanted"), F.inline(F.slice("here", 1, k)))
    order = [*FOV_KEYS, "z", "x", "y", "cell_id"]
    placed = _curve(points, boxes).repartitionByRange(*order).sortWithinPartitions(*order)
    arrays = ", ".join(f"`{c}` array<{kinds[c]}>" for c in listed)
    limits = ["x0", "x1", "y0", "y1", "reach"]

    def cut(batches):
        for i, rows in enumerate(_pieces(batches)):
            column = {name: rows.column(j) for j, name in enumerate(rows.schema.names)}
            x, y, wanted = (column[c].to_numpy(zero_copy_only=False) for c in ("x", "y", "wanted"))
            found = [stretch[-1] for stretch in _Points(column["cell_id"], x, y).search(rows.num_rows, wanted, k)]
            number = (int(column["part"][0].as_py()) << 32) + i
            yield pa.RecordBatch.from_arrays(
                [
                    *(column[c].slice(0, 1) for c in FOV_KEYS), pa.array([number], pa.int64()), *(_one(column[c]) for c in (*listed, "wanted")),
                    *(pa.array([float(v)]) for v in (x.min(), x.max(), y.min(), y.max())), pa.array([max((f[4] for f in found), default=None)], pa.float64()),
                    *(_one(pa.array([float(f[j]) for f in found], pa.float64())) for j in range(5)),
                ],
                names=[*FOV_KEYS, "tile", *listed, "wanted", *limits, *(f"s_{c}" for c in limits)],
            )

    keys = ", ".join(f"`{c}` {kinds[c]}" for c in FOV_KEYS)
    schema = f"{keys}, tile long, {arrays}, wanted array<boolean>, " + ", ".join(f"{c} double" for c in limits) + ", " + ", ".join(f"s_{c} array<double>" for c in limits)
    tiles = durable(placed.withColumn("part", F.spark_partition_id()).drop("z").mapInArrow(cut, schema))

    # who asks whom; a tile without k other cells is bounded by the tiles that hold k
    light = tiles.select(*FOV_KEYS, "tile", *limits, F.size("cell_id").alias("n"))
    others = light.select(*FOV_KEYS, F.col("tile").alias("other"), F.col("n").alias("n_other"), *[F.col(c).alias(f"b_{c}") for c in limits[:4]])
    met = light.where("reach IS NOT NULL").join(others, FOV_KEYS).where("tile <> other")
    gap = lambda v: F.greatest(F.col(f"{v}0") - F.col(f"b_{v}1"), F.col(f"b_{v}0") - F.col(f"{v}1"), F.lit(0.0))
    far = lambda v: F.greatest(F.col(f"{v}1") - F.col(f"b_{v}0"), F.col(f"b_{v}1") - F.col(f"{v}0"))
    full = met.where((F.col("reach") == float("inf")) & (F.col("n_other") >= k))
    bounds = full.groupBy("tile").agg(F.min(far("x") * far("x") + far("y") * far("y")).alias("bound"))
    within = F.least("reach", F.coalesce("bound", F.lit(float("inf"))))
    asks = met.join(bounds, "tile", "left").withColumn("reach", within).where(gap("x") * gap("x") + gap("y") * gap("y") <= F.col("reach"))
    stretches = tiles.select("tile", *(f"s_{c}" for c in limits))
    ask = F.struct("tile", "reach", *(f"s_{c}" for c in limits)).alias("ask")
    asked = asks.select("tile", "other", "reach").join(stretches, "tile").groupBy("other").agg(F.collect_list(ask).alias("asks"))

    def send(batches):
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                own = {c: column[c][i].values for c in listed}
                x, y = (own[c].to_numpy(zero_copy_only=False) for c in ("x", "y"))
                for a in column["asks"][i].as_py():
                    sent = np.zeros(len(x), bool)
                    for box in zip(*(a[f"s_{c}"] for c in limits)):
                        sent |= _gap(x, y, box) <= min(box[4], a["reach"])
                    if sent.any():
                        at = pa.array(np.flatnonzero(sent))
                        yield pa.RecordBatch.from_arrays([pa.array([a["tile"]], pa.int64()), *(_one(own[c].take(at)) for c in listed)], names=["tile", *listed])

    sent = tiles.select(F.col("tile").alias("other"), *listed).join(asked, "other").mapInArrow(send, f"tile long, {arrays}")
    halo = sent.groupBy("tile").agg(*[F.flatten(F.collect_list(F.struct(*listed)).getField(c)).alias(f"h_{c}") for c in listed])

    def solve(batches):
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                own = {c: column[c][i].values for c in (*listed, "wanted")}
                every = {c: own[c] if column[f"h_{c}"][i].values is None else pa.concat_arrays([own[c], column[f"h_{c}"][i].values]) for c in listed}
                x, y = (every[c].to_numpy(zero_copy_only=False) for c in ("x", "y"))
                n = len(own["wanted"])
                found = list(_Points(every["cell_id"], x, y).search(n, own["wanted"].to_numpy(zero_copy_only=False), k))
                asked, value, place = (np.concatenate([f[j] for f in found]) for j in range(3))
                near = _near(value, place, every["cell_id"] if ids else None, {c: every[c] for c in columns})
                fov = [pa.array([column[c][i].as_py()] * len(asked), column[c].type) for c in FOV_KEYS]
                yield pa.RecordBatch.from_arrays([*fov, own["cell_id"].take(pa.array(asked)), near], names=[*FOV_KEYS, "cell_id", "near"])

    near_type = "array<struct<" + ", ".join([*([f"dist2: double, neighbor_id: {kinds['cell_id']}"] if ids else []), *(f"`{c}`: {kinds[c]}" for c in columns)]) + ">>"
    own = tiles.where("reach IS NOT NULL").select(*FOV_KEYS, "tile", *listed, "wanted")
    return own.join(halo, "tile", "left").mapInArrow(solve, f"{keys}, cell_id {kinds['cell_id']}, near {near_type}")


def _large(cells: DataFrame, boxes: DataFrame, k: int, columns: list[str], ids: bool) -> DataFrame:
    """Neighbours for large FOVs: within crowded places at once, for all others by tiles."""
    places = durable(_places(cells, k, columns))
    kinds = places.select((F.size("here") > k).alias("crowded")).distinct().collect()
    parts = []
    if any(not r["crowded"] for r in kinds):
        parts.append(_tiled(places, boxes, k, columns, ids))
    if any(r["crowded"] for r in kinds):
        others = F.slice(F.filter("here", lambda p: p["cell_id"] != F.col("cell_id")), 1, k)
        fields = lambda p: [*([F.lit(0.0).alias("dist2"), p["cell_id"].alias("neighbor_id")] if ids else []), *[p[c].alias(c) for c in columns]]
        crowded = places.where(F.size("here") > k)
        at_once = cells.select(*FOV_KEYS, "x", "y", "cell_id").join(crowded, [*FOV_KEYS, "x", "y"])
        parts.append(at_once.select(*FOV_KEYS, "cell_id", F.transform(others, lambda p: F.struct(*fields(p))).alias("near")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def nearest_lists(cells: DataFrame, k: int, columns: list[str] | None = None, on_small_fov: str = "error", ids: bool = True) -> DataFrame:
    """One row per cell with its sorted neighbour array; without ``ids`` that has only the ``columns``.

    A FOV with fewer than k + 1 cells raises (``error``), keeps the neighbours it has
    (``shrink``), or is left out (``quarantine``). Coordinates must be finite numbers: a
    null, NaN or infinite one raises, as it has no distance to anything. The size of a FOV
    decides how its neighbours are found, not which they are.
    """
    columns = columns or []
    base = cells.select(*FOV_KEYS, "cell_id", _finite("x"), _finite("y"), *columns)
    sizes = base.groupBy(*FOV_KEYS).agg(F.count(F.lit(1)).alias("n_fov"))
    bounds = sizes.agg(F.min("n_fov").alias("least"), F.max("n_fov").alias("most")).first()
    if on_small_fov == "error" and bounds["most"] is not None and bounds["least"] < k + 1:
        raise ValueError(f"a FOV has {bounds['least']} cells, fewer than k + 1 = {k + 1}")
    if bounds["most"] is None or bounds["most"] <= SMALL_FOV:
        out = _small(base, k, columns, ids)
    else:
        base = durable(base)
        span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-12))
        boxes = base.groupBy(*FOV_KEYS).agg(F.count(F.lit(1)).alias("n_fov"), F.min("x").alias("x0"), F.min("y").alias("y0"), span.alias("span"))
        boxes = durable(boxes.where(F.col("n_fov") > SMALL_FOV))
        if bounds["least"] > SMALL_FOV:
            out = _large(base, boxes, k, columns, ids)
        else:
            out = _small(base.join(boxes, FOV_KEYS, "left_anti"), k, columns, ids)
            out = out.unionByName(_large(base.join(boxes, FOV_KEYS, "left_semi"), boxes, k, columns, ids))
    if on_small_fov == "quarantine":
        out = out.where(F.size("near") == k)
    return out


def nearest_neighbors(cells: DataFrame, k: int, on_small_fov: str = "error") -> DataFrame:
    """Long form: cell, rank, neighbour and distance."""
    lists = nearest_lists(cells, k, on_small_fov=on_small_fov)
    return lists.select(*FOV_KEYS, "cell_id", F.posexplode("near").alias("p", "n")).select(
        *FOV_KEYS, "cell_id", (F.col("p") + 1).alias("rank"), F.col("n.neighbor_id").alias("neighbor_id"), F.sqrt("n.dist2").alias("distance")
    )


def neighborhood_vectors(cells: DataFrame, k: int, subtypes: list[str], on_small_fov: str = "error") -> DataFrame:
    """Share of each type among the neighbours, one array per cell in the given type order.

    A type outside ``subtypes`` raises: leaving it out would make the shares sum to less than one.
    """
    known = F.coalesce(F.col("cell_subtype_label").isin(subtypes), F.lit(False))
    label = F.when(known, F.col("cell_subtype_label")).otherwise(F.raise_error(F.lit("a cell type is not among the given ones")))
    lists = nearest_lists(cells.withColumn("cell_subtype_label", label), k, ["cell_subtype_label"], on_small_fov, ids=False)
    found = F.size("near")
    share = lambda t: F.size(F.filter("near", lambda p: p["cell_subtype_label"] == t)) / F.when(found > 0, found)
    return lists.select(*FOV_KEYS, "cell_id", F.array(*[F.coalesce(share(t), F.lit(0.0)) for t in subtypes]).alias("features"))


def neighborhood_mix(cells: DataFrame, k: int, subtypes: list[str], on_small_fov: str = "error") -> DataFrame:
    vectors = neighborhood_vectors(cells, k, subtypes, on_small_fov)
    names = F.array(*[F.lit(t) for t in subtypes])
    pairs = F.arrays_zip(names.alias("subtype"), F.col("features").alias("fraction"))
    return vectors.select(*FOV_KEYS, "cell_id", F.inline(pairs)).toDF(*FOV_KEYS, "cell_id", "subtype", "fraction")


def fov_mean_features(vectors: DataFrame, labels: list[str]) -> DataFrame:
    """Mean feature vector per FOV, long."""
    means = vectors.groupBy(*FOV_KEYS).agg(
        *[F.avg(F.get("features", F.lit(i))).alias(f"m{i}") for i in range(len(labels))]
    )
    items = F.array(*[F.struct(F.lit(t).alias("subtype"), F.col(f"m{i}").alias("fraction")) for i, t in enumerate(labels)])
    return means.select(*FOV_KEYS, F.inline(items))


def grid_blocks(cells: DataFrame, g: int) -> DataFrame:
    """Block (row, column) of every cell in a g x g grid over its FOV; a flat axis counts as width one."""
    box = cells.groupBy(*FOV_KEYS).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )

    def index(v: str, lo: str, hi: str) -> Column:
        width = F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(1.0)
        return F.least(F.floor((F.col(v) - F.col(lo)) / width * g), F.lit(g - 1)).cast("int")

    return cells.join(box, FOV_KEYS).select(
        *FOV_KEYS, "cell_id", index("y", "y0", "y1").alias("block_row"), index("x", "x0", "x1").alias("block_col")
    )


def block_bootstrap(blocks: DataFrame, g: int, replicates: int, seed: str) -> DataFrame:
    """Resampled blocks per FOV and replicate, with how often each was drawn and its cells.

    A FOV has at most g x g blocks: the draws of a replicate fit in one array and are counted in it.
    """
    sizes = blocks.groupBy(*FOV_KEYS, "block_row", "block_col").agg(F.count(F.lit(1)).alias("n_cells"))
    listed = sizes.groupBy(*FOV_KEYS).agg(F.array_sort(F.collect_list(F.struct("block_row", "block_col", "n_cells"))).alias("b"))
    reps = listed.select(*FOV_KEYS, "b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    slots = F.sequence(F.lit(1), F.size("b"))
    picks = F.transform(slots, lambda s: (draw(seed, F.concat_ws("|", *FOV_KEYS), F.col("replicate"), s) % F.size("b")).cast("int"))
    listed = reps.withColumn("picks", picks).select(*FOV_KEYS, "replicate", "picks", F.posexplode("b").alias("at", "p"))
    counted = listed.withColumn("n_drawn", F.size(F.filter("picks", lambda i: i == F.col("at"))).cast("long")).where("n_drawn > 0")
    return counted.select(
        *FOV_KEYS, "replicate", F.col("p.block_row").alias("block_row"), F.col("p.block_col").alias("block_col"), "n_drawn", F.col("p.n_cells").alias("n_cells")
    )


def replicate_cells(drawn: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cells of a replicate with their multiplicity."""
    return blocks.join(drawn.drop("n_cells"), [*FOV_KEYS, "block_row", "block_col"])
