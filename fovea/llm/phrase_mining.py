"""Phrases by vertical partitioning of a depth-truncated suffix tree.

Word prefixes are grouped until a group's suffixes fill a memory budget; a prefix with more
occurrences than the budget is extended by a word and asked for again. Every group then gets
its suffixes, cut after five words and counted once per block of documents, sorts them into
its part of the suffix tree independently of all others, and reads the count of a node off
the totals of its leaves. Words, pairs and prefixes below the smallest count that matters
cannot be part of a phrase; they end suffixes early.

Blocks and prefixes meet by shuffles in both directions: no list of words or prefixes is held
anywhere as a whole. What is surely rare is found first by sums over 64-bit hashes, which
travel packed; only the rest is spelled out and counted exactly.

Defined results: a null text is empty, a null language is ``und``, empty pieces have no
words, repeated rows count each, other columns are not read, an empty table has no phrases.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.llm.blocks import block_spans, first_block_id, press, text_sizes, unpress, utf8
from fovea.llm.words import mix, pack_numbers, unpack, unpack_numbers
from fovea.runtime import shuffle_width, write_stage

DEPTH = 5
MIN_COUNT = 100
#: Suffixes that one subtree is built from at a time.
GROUP_SUFFIXES = 4_000_000
#: Hashes of words or pairs that are summed at a time.
BUCKET_HASHES = 2_000_000
BLOCK_BYTES = 8 << 20
#: Group numbers of prefixes that must be extended, and of those that need no group.
HEAVY, SETTLED = -1, -2

# Fixed values of the task: what ends a piece, what separates words.
_PIECE_ENDS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"


def _byte_map() -> bytes:
    out = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    for b in _PIECE_ENDS:
        out[b] = ord("\n")
    for b in _SPACES:
        out[b] = ord(" ")
    return bytes(out)


_BYTE_MAP = _byte_map()


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words of the texts as places in the list of different words, -1 where a piece ends."""
    tokens = b"\n".join(texts).translate(_BYTE_MAP).replace(b"\n", b" \n ").split(b" ")
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    index[b""], index[b"\n"] = 0, 1
    codes = np.fromiter(map(index.__getitem__, tokens), np.int32, len(tokens))
    return codes[codes > 0] - 2, list(index)[2:]


def press_planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values, np.int32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpress_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(-1)


# --- blocks ----------------------------------------------------------------------

_CODED = "block long, langs array<string>, lang_words array<long>, sizes array<long>, spelled binary, lengths binary, counts binary, seq binary, n long"


def _pack_words(langs: list[str], words: list[list[bytes]], counts: np.ndarray) -> dict:
    """Words by language as one compressed text."""
    flat = [w for own in words for w in own]
    return {
        "langs": langs, "sizes": [len(own) for own in words], "spelled": zstandard.ZstdCompressor(level=3).compress(b"".join(flat)),
        "lengths": press_planes(np.array([len(w) for w in flat], np.int32)), "counts": pack_numbers(counts, level=3),
    }


def _unpack_words(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, number of the language of each, counts)."""
    words = unpack(row["spelled"], unpress_planes(row["lengths"]).tolist())
    return words, np.repeat(np.arange(len(row["sizes"])), row["sizes"]), unpack_numbers(row["counts"]).astype(np.int64)


def _coded(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks as their different words with counts, and the text as places in that list."""

    def run(batches):
        block = first_block_id()
        for batch in batches:
            for lo, hi in block_spans(text_sizes(batch.column(1)), block_bytes):
                langs, texts = batch.column(0).slice(lo, hi - lo).to_pylist(), utf8(batch.column(1).slice(lo, hi - lo))
                by_lang: dict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(langs, texts):
                    by_lang[lang].append(text)
                seq, words, counts, n = [], [], [], 0
                for own in by_lang.values():
                    codes, different = word_codes(own)
                    counts.append(np.bincount(codes[codes >= 0], minlength=len(different)))
                    seq += [np.where(codes >= 0, codes + np.int32(n), np.int32(-1)), np.array([-1], np.int32)]
                    words.append(different)
                    n += len(different)
                text = np.concatenate(seq)
                row = {"block": block, "lang_words": [int(c.sum()) for c in counts], "seq": press_planes(text), "n": n + len(text)}
                yield pa.RecordBatch.from_pylist([row | _pack_words(list(by_lang), words, np.concatenate(counts))], schema=_CODED_TYPES)
                block += 1

    return write_stage(docs.mapInArrow(run, _CODED), "coded")


def _hashes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash per word, hash per different pair of neighbours, count per pair, first position of every pair, its number)."""
    digest, seq = xxhash.xxh3_64_intdigest, unpress_planes(row["seq"])
    words, lang, _ = _unpack_words(row)
    seeds = [digest(name.encode()) for name in row["langs"]]
    word = np.fromiter((digest(w, seeds[k]) for w, k in zip(words, lang.tolist())), np.uint64, len(words))
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    key, number, counts = np.unique(seq[at].astype(np.int64) * len(words) + seq[at + 1], return_inverse=True, return_counts=True)
    pair = mix(mix(word[key // max(1, len(words))]) + word[key % max(1, len(words))])
    return word, pair, counts, at, number


def _common(coded: DataFrame, min_count: int, bucket_hashes: int) -> tuple[DataFrame, int]:
    """((block, common array<struct<bucket, n, bits>>), bits of a hash): which hashes of words and pairs sum up to ``min_count``.

    A block sends a bucket one packed row with its hashes of that range and gets one row of
    bits back. Hashes are as short as the number of them allows; where two meet, more pass.
    """
    total = coded.agg(F.sum("n")).first()[0] or 0
    width = min(64, int(total).bit_length() + 6)
    bits = max(1, int(max(shuffle_width(coded.sparkSession), total / bucket_hashes) - 1).bit_length())

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                word, pair, times, _, _ = _hashes(row)
                hashes, inverse = np.unique(np.concatenate([word, pair]) >> np.uint64(64 - width), return_inverse=True)
                counts = np.zeros(len(hashes), np.int64)
                np.add.at(counts, inverse, np.concatenate([unpack_numbers(row["counts"]).astype(np.int64), times]))
                bucket = (hashes >> np.uint64(width - bits)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                out = [(int(bucket[a]), row["block"], pack_numbers(hashes[a:b], True), pack_numbers(counts[a:b])) for a, b in zip(cut, [*cut[1:], len(bucket)])]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.binary(), pa.binary()])], names=["bucket", "block", "hashes", "counts"]
                    )

    def add(table: pa.Table) -> pa.Table:
        each = [unpack_numbers(h.as_py(), True) for h in table.column("hashes")]
        hashes = np.concatenate(each)
        counts = np.concatenate([unpack_numbers(c.as_py()).astype(np.int64) for c in table.column("counts")])
        order = np.argsort(hashes, kind="stable")
        found = hashes[order]
        start = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        sums = np.add.reduceat(counts[order], start)
        often = np.empty(len(hashes), bool)
        often[order] = np.repeat(sums >= min_count, np.diff(np.append(start, len(found))))
        ends = np.cumsum([0, *map(len, each)]).tolist()
        bits_of = [np.packbits(often[a:b]).tobytes() for a, b in zip(ends, ends[1:])]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "n": pa.array(list(map(len, each)), pa.int64()), "bits": pa.array(bits_of, pa.binary())})

    sent = coded.select("block", "langs", "sizes", "spelled", "lengths", "counts", "seq").mapInArrow(send, "bucket long, block long, hashes binary, counts binary")
    back = sent.groupBy("bucket").applyInArrow(add, "bucket long, block long, n long, bits binary")
    return back.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias("common")), width


def _trimmed(coded: DataFrame, min_count: int, bucket_hashes: int) -> DataFrame:
    """Blocks without words and neighbours that are surely rare: runs end there, words left alone go from the text."""
    common, width = _common(coded, min_count, bucket_hashes)

    def trim(batches):
        for batch in batches:
            for row in batch.to_pylist():
                word, pair, _, at, number = _hashes(row)
                _, inverse = np.unique(np.concatenate([word, pair]) >> np.uint64(64 - width), return_inverse=True)
                often = np.concatenate([np.unpackbits(np.frombuffer(c["bits"], np.uint8), count=c["n"]) for c in row["common"]]).astype(bool)[inverse]
                seq = unpress_planes(row["seq"])
                bound = np.zeros(len(seq) + 1, bool)  # is the word joined to the one before?
                bound[at[often[len(word) :][number]] + 1] = True
                on = bound[:-1] | bound[1:]
                opened = np.flatnonzero(on & ~bound[:-1])
                seq = np.insert(seq, opened, -1)[np.insert(on, opened, True)]
                words, lang, counts = _unpack_words(row)
                kept = np.flatnonzero(often[: len(word)])
                new = np.full(len(word) + 1, -1, np.int32)  # the last one stands for -1
                new[kept] = np.arange(len(kept), dtype=np.int32)
                own = [[words[i] for i in kept[lang[kept] == k]] for k in range(len(row["langs"]))]
                out = {"block": row["block"], "lang_words": None, "seq": press_planes(new[seq]), "n": len(kept)} | _pack_words(row["langs"], own, counts[kept])
                yield pa.RecordBatch.from_pylist([out], schema=_CODED_TYPES)

    parts = coded.select("block", "langs", "sizes", "spelled", "lengths", "counts", "seq").join(common, "block")
    return write_stage(parts.mapInArrow(trim, _CODED), "trimmed")


_NUMBERED = "bucket long, block long, places binary, ids binary, groups binary, words array<struct<id: bigint, lang: string, word: string, f: bigint, grp: bigint>>"


def _numbered(trimmed: DataFrame, min_count: int, budget: int, bucket_hashes: int) -> DataFrame:
    """Exact counts of the words, with ids and groups.

    Rows with a block answer it (ids and groups of the words it sent, -1 for rare ones); rows
    without list the frequent words of a bucket.
    """
    total = trimmed.agg(F.sum("n")).first()[0] or 0
    bits = max(1, int(max(shuffle_width(trimmed.sparkSession), total / bucket_hashes) - 1).bit_length())

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, lang, counts = _unpack_words(row)
                seeds = [xxhash.xxh3_64_intdigest(name.encode()) for name in row["langs"]]
                bucket = np.array([xxhash.xxh3_64_intdigest(w, seeds[k]) >> (64 - bits) for w, k in zip(words, lang.tolist())], np.int64)
                order = np.argsort(bucket, kind="stable")  # by language inside a bucket
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
                out = []
                for a, b in zip(cut, [*cut[1:], len(order)]):
                    places = order[a:b]
                    own = [[words[i] for i in places[lang[places] == k]] for k in range(len(seeds))]
                    out.append({"bucket": int(bucket[places[0]]), "block": row["block"], "places": pack_numbers(places, True, 3)} | _pack_words(row["langs"], own, counts[places]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_SENT_TYPES)

    def count(table: pa.Table) -> pa.Table:
        index: dict[tuple[str, bytes], int] = {}
        numbers, sums = [], []
        for row in table.drop_columns(["bucket", "block", "places"]).to_pylist():
            words, lang, counts = _unpack_words(row)
            numbers.append(np.array([index.setdefault((row["langs"][k], w), len(index)) for w, k in zip(words, lang.tolist())], np.int64))
            sums.append(counts)
        f = np.zeros(len(index), np.int64)
        np.add.at(f, np.concatenate(numbers), np.concatenate(sums))
        bucket = table.column("bucket")[0].as_py()
        on = np.flatnonzero(f >= min_count)
        ids, groups = np.full(len(f), -1, np.int64), np.full(len(f), SETTLED, np.int64)
        ids[on] = (bucket << 32) + np.arange(len(on))
        groups[on], _ = _filled(f[on], 1, bucket, budget)
        listed = list(index)
        entries = [{"id": int(ids[i]), "lang": listed[i][0], "word": listed[i][1].decode(), "f": int(f[i]), "grp": int(groups[i])} for i in on]
        rows = [
            {"bucket": bucket, "block": b, "places": p, "ids": pack_numbers(ids[n], level=3), "groups": pack_numbers(groups[n], level=3), "words": None}
            for b, p, n in zip(table.column("block").to_pylist(), table.column("places").to_pylist(), numbers)
        ]
        return pa.Table.from_pylist([*rows, {"bucket": bucket, "block": None, "places": None, "ids": None, "groups": None, "words": entries}], schema=_NUMBERED_TYPES)

    sent = trimmed.select("block", "langs", "sizes", "spelled", "lengths", "counts").mapInArrow(
        send, "bucket long, block long, places binary, langs array<string>, sizes array<long>, spelled binary, lengths binary, counts binary"
    )
    return write_stage(sent.groupBy("bucket").applyInArrow(count, _NUMBERED), "numbered")


def _filled(f: np.ndarray, level: int, part: int, budget: int, bin_: int = 0, load: int = 0) -> tuple[np.ndarray, tuple[int, int]]:
    """Groups of prefixes with these counts, filled in turn up to the budget; where filling stands."""
    groups = np.full(len(f), SETTLED, np.int64)
    if level < DEPTH:
        for i, size in enumerate(f.tolist()):
            if size > budget:
                groups[i] = HEAVY
                continue
            load += size
            if load > budget:
                bin_, load = bin_ + 1, size
            groups[i] = (level << 56) | (part << 31) | bin_
    return groups, (bin_, load)


def _grouped(counted: DataFrame, level: int, budget: int) -> DataFrame:
    """Fills groups (``grp``) with prefixes up to the budget of suffixes.

    Every task fills groups of its own, so no prefix is moved for it; a prefix that alone is
    over the budget is marked to be extended, one of full depth needs no group.
    """

    def run(batches):
        part, state = TaskContext.get().partitionId(), (0, 0)
        for batch in batches:
            groups, state = _filled(batch.column("f").to_numpy(), level, part, budget, *state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups)], names=[*batch.schema.names, "grp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema.fields) + ", grp long"
    return write_stage(counted.mapInArrow(run, schema), "prefixes")


def _walk(seq: np.ndarray, width: int, levels: list[np.ndarray], visit=None):
    """Follows the prefixes of all positions through the known levels.

    ``levels[d]`` holds the group of every different prefix of d + 1 words in the block;
    ``visit(depth, positions, groups)`` sees the positions whose prefix has a group. Returns
    (positions, number of their prefix, a position of every different prefix) one level
    further, for prefixes that are extended.
    """
    at = np.flatnonzero(seq >= 0)
    code = seq[at].astype(np.int64)
    for depth, groups in enumerate(levels, 1):
        g = groups[code]
        if visit is not None:
            own = g >= 0
            visit(depth, at[own], g[own])
        on = g == HEAVY
        at, code = at[on], code[on]
        on = at + depth < len(seq)
        at, code = at[on], code[on]
        following = seq[at + depth]
        on = following >= 0
        at, key = at[on], code[on] * width + following[on]
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        first = at[first] if len(at) else first
    return at, code, first


_RUNS = "block long, seq binary, ids binary, levels array<binary>"
_CODED_TYPES = pa.schema([
    ("block", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("spelled", pa.binary()),
    ("lengths", pa.binary()), ("counts", pa.binary()), ("seq", pa.binary()), ("n", pa.int64()),
])
_SENT_TYPES = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())),
    ("spelled", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary()),
])
_NUMBERED_TYPES = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("ids", pa.binary()), ("groups", pa.binary()),
    ("words", pa.list_(pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("grp", pa.int64())]))),
])
_RUN_TYPES = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("ids", pa.binary()), ("levels", pa.list_(pa.binary()))])


def _state(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return unpress_planes(row["seq"]), unpress(row["ids"], np.int64), [unpress(x, np.int64) for x in row["levels"]]


def _runs(trimmed: DataFrame, numbered: DataFrame) -> DataFrame:
    """Blocks with the ids and groups of their words; words that are rare after all end a run."""
    back = numbered.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("places", "ids", "groups")).alias("known"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                joined = lambda name, rising=False: np.concatenate([unpack_numbers(k[name], rising) for k in row["known"]]).view(np.int64)
                places, ids, groups = joined("places", True), joined("ids"), joined("groups")
                order = np.argsort(places)
                ids, groups = ids[order], groups[order]
                new = np.append(np.where(ids >= 0, np.arange(len(ids)), -1), -1).astype(np.int32)
                yield pa.RecordBatch.from_pylist(
                    [{"block": row["block"], "seq": press_planes(new[unpress_planes(row["seq"])]), "ids": press(ids), "levels": [press(groups)]}], schema=_RUN_TYPES
                )

    return write_stage(trimmed.select("block", "seq").join(back, "block").mapInArrow(run, _RUNS), "runs")


def _extended(runs: DataFrame, depth: int, budget: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(runs that know the groups of prefixes of ``depth`` words, table of these prefixes)."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seq, ids, levels = _state(row)
                at, code, first = _walk(seq, len(ids), levels)
                if len(at):
                    prefix = ids[seq[first[:, None] + np.arange(depth)]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(first), row["block"], np.int64)), pa.array(np.arange(len(first), dtype=np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * depth), pa.array(prefix.ravel())),
                            pa.array(np.bincount(code, minlength=len(first)).astype(np.int64)),
                        ],
                        names=["block", "place", "path", "n"],
                    )

    asked = write_stage(runs.mapInArrow(ask, "block long, place int, path array<long>, n long"), "asked")
    table = _grouped(asked.groupBy("path").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), depth, budget)
    back = asked.join(table, "path").groupBy("block").agg(F.collect_list(F.struct("place", "grp")).alias("known"))

    def learn(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seq, ids, levels = _state(row)
                _, _, first = _walk(seq, len(ids), levels)
                groups = np.full(len(first), SETTLED, np.int64)
                for k in row["known"] or []:
                    groups[k["place"]] = k["grp"]
                row["levels"] = [*row["levels"], press(groups)]
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("block", "seq", "ids", "levels")}], schema=_RUN_TYPES)

    return write_stage(runs.join(back, "block", "left").mapInArrow(learn, _RUNS), "runs"), table


def _suffixes(runs: DataFrame) -> DataFrame:
    """(grp, depth, n, data): the different suffixes of a block for one group, with their counts.

    ``depth`` is the length of the group's prefixes; a suffix that ends there adds nothing.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seq, ids, levels = _state(row)
                width = len(ids) + 1
                padded = np.concatenate([seq, np.full(DEPTH, -1, np.int32)])
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                _walk(seq, len(ids), levels, lambda depth, at, groups: found.append((depth, at, groups)))
                for depth, at, groups in found:
                    on = padded[at + depth] >= 0
                    at, groups = at[on], groups[on]
                    if not len(at):
                        continue
                    suffix = np.full((len(at), DEPTH), -1, np.int64)
                    suffix[:, 0], code, alive = padded[at], padded[at].astype(np.int64), np.ones(len(at), bool)
                    for d in range(1, DEPTH):
                        following = np.where(alive, padded[at + d], -1)
                        alive = following >= 0
                        suffix[:, d] = following
                        _, code = np.unique(code * width + following + 1, return_inverse=True)
                    _, first, counts = np.unique(code, return_index=True, return_counts=True)
                    suffix, groups = suffix[first], groups[first]
                    order = np.argsort(groups, kind="stable")
                    groups, counts, suffix = groups[order], counts[order], suffix[order]
                    spelled = np.where(suffix >= 0, ids[suffix], -1)
                    starts = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
                    ends = [*starts[1:].tolist(), len(groups)]
                    out = [
                        (int(groups[a]), depth, b - a, pack_numbers(np.vstack([spelled[a:b].T, counts[a:b]]).ravel(), level=3))
                        for a, b in zip(starts.tolist(), ends)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.binary()])], names=["grp", "depth", "n", "data"]
                    )

    return runs.mapInArrow(run, "grp long, depth int, n long, data binary")


def _subtrees(suffixes: DataFrame, min_count: int) -> DataFrame:
    """(path, f): nodes below the prefixes of every group, counted from the totals of their leaves."""

    def build(table: pa.Table) -> pa.Table:
        sizes_in = table.column("n").to_pylist()
        rows, end = np.empty((DEPTH + 1, sum(sizes_in)), np.int64), 0
        for n, data in zip(sizes_in, table.column("data")):
            rows[:, end : end + n] = unpack_numbers(data.as_py()).view(np.int64).reshape(DEPTH + 1, n)
            end += n
        order = np.lexsort(rows[DEPTH - 1 :: -1])
        for column in rows:
            column[:] = column[order]
        paths, sizes, counts = [], [], []
        changed = np.zeros(rows.shape[1], bool)
        changed[:1] = True
        for d in range(DEPTH):
            changed[1:] |= rows[d, 1:] != rows[d, :-1]
            if d < table.column("depth")[0].as_py():
                continue
            starts = np.flatnonzero(changed)
            total = np.add.reduceat(rows[DEPTH], starts)
            on = (rows[d, starts] >= 0) & (total >= min_count)
            paths.append(rows[: d + 1, starts[on]].T.ravel())
            sizes.append(np.full(int(on.sum()), d + 1, np.int32))
            counts.append(total[on])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.table({"path": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(paths))), "f": pa.array(np.concatenate(counts))})

    return suffixes.groupBy("grp").applyInArrow(build, "path array<long>, f long")


def phrase_counts(
    docs: DataFrame, min_count: int = MIN_COUNT, budget: int = GROUP_SUFFIXES, lang_col: str = "lang", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, vocabulary, totals), all staged: every phrase of up to five words with at least ``min_count`` occurrences.

    nodes: path (word ids), f. vocabulary: id, lang, word, f. totals: lang, n (all words).
    """
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    coded = _coded(docs, block_bytes)
    totals = coded.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.lang_words").alias("n"))
    trimmed = _trimmed(coded, min_count, BUCKET_HASHES)
    numbered = _numbered(trimmed, min_count, budget, BUCKET_HASHES)
    vocabulary = numbered.where("block IS NULL").select(F.inline("words"))
    runs, heavy = _runs(trimmed, numbered), vocabulary
    nodes = [vocabulary.select(F.array("id").alias("path"), "f")]
    for depth in range(2, DEPTH + 1):
        if heavy.where(F.col("grp") == HEAVY).isEmpty():
            break
        runs, heavy = _extended(runs, depth, budget, min_count)
        nodes.append(heavy.select("path", "f"))
    nodes.append(_subtrees(_suffixes(runs), min_count))
    everything = nodes[0]
    for part in nodes[1:]:
        everything = everything.unionByName(part)
    return write_stage(everything, "nodes"), vocabulary, totals


def _name(path: Column, one: str, two: str) -> list[Column]:
    """96 bits that stand for a path in joins, which then need not move it."""
    return [F.xxhash64(path).alias(one), F.hash(path).alias(two)]


def _exact(c: Column | str) -> Column:
    """A 64-bit count as a number whose products stay exact."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    top: int = 2000,
    min_count: int = MIN_COUNT,
    budget: int = GROUP_SUFFIXES,
    lang_col: str = "lang",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to five words per language.

    A phrase inside a longer candidate of the same count is left out: if a much longer one
    has that count, so has the one that is a single word longer, so these are enough.
    """
    nodes, vocabulary, totals = phrase_counts(docs, min_count, budget, lang_col, text_col, block_bytes)
    size, own = F.size("path"), ["a1", "a2"]
    named = nodes.select("path", "f", *_name(F.col("path"), *own))
    subs = F.array(*[F.struct(*_name(F.slice("path", at, size - 1), *own)) for at in (1, 2)])
    longer = nodes.where(size > 2).select(F.explode(subs).alias("s"), "f").select("s.*", "f")
    kept = write_stage(named.where(size > 1).join(longer, [*own, "f"], "left_anti"), "candidates")

    words = vocabulary.select(F.col("id").alias("word_id"), "word", "lang")
    spelled = (
        kept.select(*own, F.posexplode("path").alias("at", "word_id")).join(words, "word_id").groupBy(*own)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"), F.first("lang").alias("lang"))
    )
    cuts = kept.select(*own, "path", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    head, rest = F.slice("path", F.lit(1), F.col("k")), F.slice("path", F.col("k") + 1, size - F.col("k"))
    sides = cuts.select(*own, "a", "k", *_name(head, "h1", "h2"), *_name(rest, "r1", "r2"))
    counts = lambda one, two, f: named.select(F.col("a1").alias(one), F.col("a2").alias(two), F.col("f").alias(f))
    measured = (
        sides.join(counts("h1", "h2", "l"), ["h1", "h2"]).join(counts("r1", "r2", "r"), ["r1", "r2"])
        .groupBy(*own, "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
        .join(spelled, own).join(totals, "lang")
    )
    score = lambda c: F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (_exact("a") * _exact("n")), _exact(c["l"]) * _exact(c["r"])).cast("long")
    scored = F.transform("cuts", lambda c: F.struct(score(c).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = measured.select("lang", "phrase", "a", "n", F.array_min(scored).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
