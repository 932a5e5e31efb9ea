"""Near-duplicate documents by BagMinHash (Ertl, 2018) over word shingles with counts.

A shingle that occurs w times owns the interval (0, w]. Poisson points on it carry a
position, a register and an arrival time, all drawn from the shingle alone; a register's
signature is the point that arrives first among those whose position the document covers.
Two documents then agree in a register with the weighted Jaccard similarity of their
shingle counts. The weights are cut at powers of two, one process per part, so a count
needs as many processes as it has binary digits; points of the last part count if their
position is below w. Points are drawn in order of arrival and only as far as registers are
still open.

Banding finds candidates, and every candidate is verified on the full shingle counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.llm.blocks import block_spans, text_sizes, utf8
from fovea.llm.words import mix, pack_numbers, unpack_numbers, window_hashes, words_of
from fovea.runtime import write_stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Registers are cut into BANDS bands of ROWS; a pair at the threshold is missed with (1 - 0.8^4)^24, about 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Members of a bucket that are compared against as many others in one task.
TILE = 1024
#: Bits of a shingle hash that bags carry; two different shingles of a pair meet with about 1e-9.
BAG_BITS = 48

_SKETCH = "uid long, doc_id long, class string, bands array<long>"


def shingle_counts(texts: list[bytes], width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the distinct shingles of each text, by document and hash.

    A text shorter than a shingle is one shingle of all its words; a text without words has none.
    """
    words = words_of(texts)
    first = words.hashes(3)
    at = np.flatnonzero(words.whole(width))
    doc, hashes = words.doc[at], window_hashes(first, width)[at]
    short = np.flatnonzero((words.lengths > 0) & (words.lengths < width))
    if len(short):
        ends = np.cumsum(words.lengths)
        own = [window_hashes(first[ends[d] - words.lengths[d] : ends[d]], int(words.lengths[d]))[0] ^ np.uint64(words.lengths[d]) for d in short]
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, np.array(own, np.uint64)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], hashes[starts], np.diff([*starts, len(doc)])


def _uniform(state: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1), one per state."""
    return ((mix(state ^ np.uint64(stream)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def bag_signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """32-bit signatures (docs x registers); documents without shingles get zeros."""
    signature = np.zeros((docs, registers), np.uint32)
    if not len(doc):
        return signature
    parts = np.ceil(np.log2(count)).astype(np.int64) + 1  # (0,1], (1,2], (2,4], ...
    owner = np.repeat(np.arange(len(doc)), parts)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype(np.float64)
    document, weight = doc[owner], count[owner].astype(np.float64)
    total = np.bincount(doc, count, minlength=docs)
    horizon = np.zeros(docs)
    some = total > 0
    # by this time a register has been hit with probability 1 - 1 / (registers * e^3)
    horizon[some] = registers * (np.log(registers) + 3.0) / total[some]
    best = np.full(docs * registers, np.inf)
    first = np.zeros(docs * registers, np.uint64)
    state = mix(shingle[owner] + mix(level.astype(np.uint64) + np.uint64(77)))
    time = -np.log(_uniform(state, 1)) / rate
    while True:
        alive = np.flatnonzero(time <= horizon[document])
        while len(alive):
            s, t, d = state[alive], time[alive], document[alive]
            register = (mix(s ^ np.uint64(2)) % np.uint64(registers)).astype(np.int64)
            position = low[alive] + rate[alive] * _uniform(s, 3)
            inside = position <= weight[alive]
            cell, arrival, mark = (d * registers + register)[inside], t[inside], s[inside]
            order = np.lexsort((arrival, cell))
            cell, arrival, mark = cell[order], arrival[order], mark[order]
            lead = np.ones(len(cell), bool)
            lead[1:] = cell[1:] != cell[:-1]
            cell, arrival, mark = cell[lead], arrival[lead], mark[lead]
            sooner = arrival < best[cell]
            best[cell[sooner]], first[cell[sooner]] = arrival[sooner], mark[sooner]
            state[alive] = mix(s + np.uint64(0x9E3779B97F4A7C15))
            time[alive] = t - np.log(_uniform(state[alive], 1)) / rate[alive]
            alive = alive[time[alive] <= horizon[d]]
        open_ = np.isinf(best.reshape(docs, registers)).any(axis=1) & some
        if not open_.any():
            break
        horizon[open_] *= 2.0
    signature[some] = (mix(first.reshape(docs, registers)[some]) >> np.uint64(32)).astype(np.uint32)
    return signature


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` staged with ``__uid``, a number of its own for every row."""
    return write_stage(docs.withColumn("__uid", F.monotonically_increasing_id()), "numbered")


def _sketches(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged class and band keys of every row; rows of a class have equal shingle counts."""

    def run(batches):
        for batch in batches:
            for lo, hi in block_spans(text_sizes(batch.column(2)), 2 << 20):
                part = batch.slice(lo, hi - lo)
                n = hi - lo
                doc, shingle, count = shingle_counts(utf8(part.column(2)))
                signature = bag_signatures(doc, shingle, count, n)
                ends = np.searchsorted(doc, np.arange(n + 1))
                uids = part.column(0).to_pylist()
                classes = []
                for d in range(n):
                    own = slice(ends[d], ends[d + 1])
                    content = shingle[own].tobytes() + count[own].astype(np.int64).tobytes()
                    # no words: nothing to compare, a class of its own
                    classes.append(hashlib.blake2b(content, digest_size=16).hexdigest() if content else f"row {uids[d]}")
                wide = signature.reshape(n, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)), (n, BANDS))
                for k in range(ROWS):
                    key = mix(key ^ (wide[:, :, k] + (np.uint64(k) << np.uint64(32))))
                bands = [None if c.startswith("row") else row.tolist() for c, row in zip(classes, key.view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1).cast(pa.int64()),
                        pa.array(classes, pa.string()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["uid", "doc_id", "class", "bands"],
                )

    return write_stage(rows.select("__uid", id_col, text_col).mapInArrow(run, _SKETCH), "sketches")


def _shingles_of(rows: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """Staged packed shingle counts of the rows in ``wanted`` (uid)."""

    def run(batches):
        for batch in batches:
            for lo, hi in block_spans(text_sizes(batch.column(1)), 2 << 20):
                part = batch.slice(lo, hi - lo)
                doc, shingle, count = shingle_counts(utf8(part.column(1)))
                shingle = shingle >> np.uint64(64 - BAG_BITS)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                spans = [slice(a, b) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([pack_numbers(shingle[s], True) for s in spans], pa.binary()),
                        pa.array([pack_numbers(count[s].astype(np.uint64)) for s in spans], pa.binary()),
                    ],
                    names=["uid", "shingles", "counts"],
                )

    # what is wanted grows with the corpus: never broadcast it, so that every size runs the same plan
    text = rows.select("__uid", text_col).join(wanted.withColumnRenamed("uid", "__uid").hint("merge"), "__uid", "left_semi")
    return write_stage(text.mapInArrow(run, "uid long, shingles binary, counts binary"), "shingles")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (ascending shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / max(1, int(a[1].sum()) + int(b[1].sum()) - common)


def _verified(bags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Staged pairs (a, b) whose shingle counts overlap enough."""
    left = bags.select(F.col("uid").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = bags.select(F.col("uid").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))

    def run(batches):
        read = lambda s, c: (unpack_numbers(s, True), unpack_numbers(c).astype(np.int64))
        for batch in batches:
            a, b, *packed = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("a", "b", "sa", "ca", "sb", "cb"))
            good, last, bag = [], None, None
            for i, (sa, ca, sb, cb) in enumerate(zip(*packed)):
                if b[i] != last:
                    last, bag = b[i], read(sb, cb)
                if overlap(read(sa, ca), bag) >= SIMILARITY:
                    good.append(i)
            if good:
                yield pa.RecordBatch.from_pydict({"a": [a[i] for i in good], "b": [b[i] for i in good]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return write_stage(pairs.join(right, "b").join(left, "a").mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """Staged (uid, root): the smallest uid of each connected component of ``links`` (a, b).

    Each round takes the smallest root among the neighbours, then the root's root, so long
    chains halve; every round is a written table, so lineage stays short.
    """
    both = write_stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = write_stage(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("uid").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("uid")).agg(F.min("r").alias("r"))
        lower = roots.join(near, "uid").select("uid", "root", F.least("root", "r").alias("next"))
        jumped = lower.join(roots.select(F.col("uid").alias("next"), F.col("root").alias("above")), "next", "left").select(
            "uid", F.coalesce(F.least("next", "above"), F.col("next")).alias("root"), (F.coalesce(F.least("next", "above"), F.col("next")) != F.col("root")).alias("moved")
        )
        roots = write_stage(jumped, "roots")
        if roots.where("moved").isEmpty():
            return roots.drop("moved")


def _buckets(reps: DataFrame) -> DataFrame:
    """(band, uid) of the representatives in buckets of two or more."""
    each = reps.select("uid", F.explode("bands").alias("band"))
    full = each.groupBy("band").agg(F.count("*").alias("n"), F.min("uid").alias("pivot")).where("n > 1")
    return each.join(full, "band")


def _across(buckets: DataFrame, bags: DataFrame, roots: DataFrame) -> DataFrame:
    """Staged links (a, b) between members of one bucket that are still in different components.

    Only buckets with several components are left here. A bucket is cut into tiles of at most
    about TILE members; each pair of tiles is one group, so that no task holds a bucket and none
    of its pairs is left out. The overlap of one member with a whole tile is one vector sum;
    pairs stay inside the task and only links leave it. A link joins its two components for
    the rest of the task, which are then not compared any more.
    """
    member = buckets.select("band", "uid").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    mixed = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mixed = mixed.withColumn("tiles", F.ceil(F.col("n") / F.lit(TILE)).cast("int")).select("band", "tiles")
    open_ = member.join(mixed, "band").join(bags, "uid")
    tile = F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = open_.withColumn("tile", tile).withColumn("other", other)
    dealt = dealt.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "uid", "root", "shingles", "counts")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        tiles, uid, root = (table.column(c).to_numpy() for c in ("tile", "uid", "root"))
        bag = [unpack_numbers(b, True) for b in table.column("shingles").to_pylist()]
        count = [unpack_numbers(c).astype(np.int64) for c in table.column("counts").to_pylist()]
        pairs = linked_pairs(bag, count, np.flatnonzero(tiles == i), np.flatnonzero(tiles == j), root.copy())
        a = [max(uid[x], uid[y]) for x, y in pairs]
        b = [min(uid[x], uid[y]) for x, y in pairs]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return write_stage(dealt.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long"), "links")


def linked_pairs(bag: list, count: list, rows: np.ndarray, columns: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of similar bags that link components; ``root`` is changed as they join.

    No two components are linked twice, and every two that any pair links end up joined.
    """
    sizes = np.array([len(x) for x in bag], np.int64)
    weight = np.array([c.sum() for c in count], np.int64)
    number = np.unique(np.concatenate(bag), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = [number[e - n : e] for e, n in zip(ends, sizes)]
    have = np.zeros(int(number.max()) + 1, np.int64)
    flat = np.concatenate([own[c] for c in columns])
    flat_count = np.concatenate([count[c] for c in columns])
    starts = np.cumsum(sizes[columns]) - sizes[columns]
    out = []
    for r in rows:
        if (root[columns] == root[r]).all():
            continue
        have[own[r]] = count[r]
        common = np.add.reduceat(np.minimum(flat_count, have[flat]), starts)
        have[own[r]] = 0
        alike = common >= SIMILARITY * (weight[r] + weight[columns] - common) - 1e-9
        for c in columns[alike]:
            if root[c] != root[r]:
                out.append((int(r), int(c)))
                root[root == root[c]] = root[r]
    return out


def _groups(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, class, rep, root) of every row of a numbered frame."""
    sketches = _sketches(rows, id_col, text_col)
    classes = sketches.groupBy("class").agg(F.min("uid").alias("rep"))
    reps = write_stage(
        sketches.where(F.col("bands").isNotNull()).join(classes.withColumnRenamed("class", "__c"), (F.col("class") == F.col("__c")) & (F.col("uid") == F.col("rep"))).select("uid", "bands"),
        "reps",
    )
    buckets = write_stage(_buckets(reps), "buckets")
    bags = _shingles_of(rows, text_col, buckets.select("uid").distinct())
    # First each member against the smallest of its bucket, then what is still apart in a bucket.
    star = buckets.where("uid != pivot").select(F.col("uid").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _verified(bags, star)
    roots = components(links)
    more = _across(buckets, bags, roots)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = sketches.select("uid", "doc_id", "class").join(classes, "class")
    return named.join(roots.select(F.col("uid").alias("rep"), "root"), "rep", "left").select("uid", "doc_id", "class", "rep", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, group_id, kept for every row.

    ``class_id``: smallest id with the same counts of five-word shingles. ``group_id``: smallest
    id of the component of documents linked by a weighted Jaccard similarity of at least 0.8;
    both are null where all ids concerned are. Exactly one row of a group is kept, the one with
    the smallest id (null ids last; of equal ids any one). Texts of fewer than five words are
    one shingle; null texts and texts without words are equal to nothing and always kept.
    Repeated rows are one class. Other columns are not read.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    found = write_stage(_groups(rows, "doc_id", "text"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    group = found.groupBy("root").agg(first.alias("first")).select(F.col("root"), F.col("first.doc_id").alias("group_id"), F.col("first.uid").alias("kept_uid"))
    named = found.groupBy("rep").agg(F.min("doc_id").alias("class_id"))
    return found.join(named, "rep").join(group, "root").select("doc_id", "class_id", "group_id", (F.col("uid") == F.col("kept_uid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps."""
    rows = numbered(docs)
    found = write_stage(_groups(rows, id_col, text_col), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.uid").alias("__uid"))
    return rows.join(kept.hint("merge"), "__uid", "left_semi").select(*docs.columns)
