"""Ranked lexical search by a dual-tree: hierarchies over items and documents, pruned in pairs.

Items are searched in blocks of bounded size, each against all documents. A node of either
tree holds, per term, the largest value below it (weight times repeats for items, impact for
documents); the product sum of two nodes bounds every score between them. A pair of nodes
goes when its bound is below the weakest kth score of the items in it, so nothing that could
be listed is lost. Kth scores start from a share of the documents that is searched first.

Documents stay where they are: tasks count the item terms of blocks of documents, Spark adds
up document frequencies, and every task searches its own blocks and sends its best.

Defined results: null texts and texts without terms are no documents and give items no rows;
equal scores are ordered by document id, null ids last; repeated rows count each; a repeated
item is listed each time; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.llm.blocks import block_spans, blocks, first_block_id, press, text_sizes, unpress, utf8
from fovea.runtime import write_stage

TOP = 10
#: Text bytes of the items that are searched at a time.
ITEM_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
#: Documents per leaf, and the share of blocks that give the first kth scores.
LEAF_DOCS, SEED_SHARE = 16, 16


def _byte_map() -> bytes:
    """Letters A to Z lower-cased; every other ASCII byte but digits and letters becomes a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


_BYTE_MAP = _byte_map()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTE_MAP).split()


# --- trees ---------------------------------------------------------------------


@dataclass
class Rows:
    """Sparse rows: the terms of row i, with a value each, at ``start[i]:start[i + 1]``."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the entries of these rows, how many each has)."""
        sizes = self.start[rows + 1] - self.start[rows]
        shift = self.start[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        return np.repeat(shift, sizes) + np.arange(int(sizes.sum())), sizes


@dataclass
class Tree:
    """Binary tree over rows: node i covers ``order[lo[i]:hi[i]]``; leaves have no children (-1)."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray


def grow_tree(rows: Rows, gain: np.ndarray, leaf: int) -> Tree:
    """Splits rows by the term that divides them most evenly, weighted by ``gain``.

    Where none does, rows are sorted by the term of most gain that they share with another
    row and halved.
    """
    order = np.arange(len(rows.start) - 1)
    lo, hi, left, right = [0], [len(order)], [-1], [-1]
    todo = [0]
    while todo:
        node = todo.pop()
        a, b = lo[node], hi[node]
        if b - a <= leaf:
            continue
        own = order[a:b]
        places, sizes = rows.at(own)
        term = rows.term[places]
        held = np.bincount(term, minlength=len(gain))
        best = int(np.argmax(gain * np.minimum(held, len(own) - held)))
        with_it, owner = np.zeros(len(own), bool), np.repeat(np.arange(len(own)), sizes)
        if 8 * min(held[best], len(own) - held[best]) >= len(own):
            with_it[owner[term == best]] = True
        else:
            by = np.lexsort((term, -gain[term] * (held[term] > 1), owner))
            strongest = term[by[np.cumsum(sizes) - sizes]]
            own = own[np.argsort(strongest, kind="stable")]
            with_it[: len(own) // 2] = True
        order[a:b] = np.concatenate([own[with_it], own[~with_it]])
        middle = a + int(with_it.sum())
        left[node], right[node] = len(lo), len(lo) + 1
        todo += [len(lo), len(lo) + 1]
        lo += [a, middle]
        hi += [middle, b]
        left += [-1, -1]
        right += [-1, -1]
    return Tree(order, *(np.array(x, np.int64) for x in (lo, hi, left, right)))


def node_maxima(tree: Tree, rows: Rows) -> Rows:
    """Per node, the largest value of every term below it."""
    start, term, value = [0], [], []
    for a, b in zip(tree.lo.tolist(), tree.hi.tolist()):
        places, _ = rows.at(tree.order[a:b])
        t, v = rows.term[places], rows.value[places]
        by = np.lexsort((-v, t))
        t, v = t[by], v[by]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        term.append(t[first])
        value.append(v[first])
        start.append(start[-1] + len(first))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Rows(np.array(start, np.int64), joined(term), joined(value))


# --- items ---------------------------------------------------------------------


@dataclass
class Items:
    """A block of items: its terms, and per item the numbers of its terms with repeats."""

    terms: dict[bytes, int]
    rows: Rows
    number: np.ndarray  # place of each item in its block

    @classmethod
    def of(cls, texts: list[bytes]) -> "Items":
        terms: dict[bytes, int] = {}
        start, term, times, number = [0], [], [], []
        for i, text in enumerate(texts):
            found = [terms.setdefault(t, len(terms)) for t in terms_of(text)]
            if found:
                t, n = np.unique(np.array(found, np.int64), return_counts=True)
                term.append(t)
                times.append(n)
                start.append(start[-1] + len(t))
                number.append(i)
        joined = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(terms, Rows(np.array(start, np.int64), joined(term), joined(times)), np.array(number, np.int64))


def item_weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)


def impacts(times: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 75 + (75 * length * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Search:
    """The best documents of every item of a block, over the blocks of documents it is shown."""

    def __init__(self, weighted: Rows, tree: Tree, maxima: Rows, n_terms: int, least: np.ndarray, top: int):
        self.weighted, self.tree, self.maxima, self.n_terms, self.top = weighted, tree, maxima, n_terms, top
        self.kth = np.concatenate([least[tree.order], [1]])  # in tree order, then a stop
        n = len(tree.order)
        self.scores, self.ids, self.unnamed = np.zeros((n, top), np.int64), np.zeros((n, top), np.int64), np.ones((n, top), bool)
        self.bounds = self.scored = 0  # node pairs bounded, pairs of an item and a document scored

    def show(self, ids: np.ndarray, unnamed: np.ndarray, docs: Rows, gain: np.ndarray) -> None:
        tree = grow_tree(docs, gain, LEAF_DOCS)
        todo = [(0, np.array([0]))] if len(ids) and len(self.tree.order) else []
        while todo:
            node, items = todo.pop()
            own = tree.order[tree.lo[node] : tree.hi[node]]
            places, sizes = docs.at(own)
            highest = np.zeros(self.n_terms, np.int64)
            np.maximum.at(highest, docs.term[places], docs.value[places])
            items = self._kept(items, highest)
            if not len(items):
                continue
            if tree.left[node] >= 0:
                items = self._below(items)
                todo += [(int(tree.right[node]), items), (int(tree.left[node]), items)]
                continue
            while (self.tree.left[items] >= 0).any():
                items = self._kept(self._below(items), highest)
            if len(items):
                self._score(items, own, docs, ids, unnamed)

    def _below(self, items: np.ndarray) -> np.ndarray:
        """Children in place of their parents, single items as they are; in tree order."""
        inner = self.tree.left[items] >= 0
        out = np.concatenate([items[~inner], self.tree.left[items[inner]], self.tree.right[items[inner]]])
        return out[np.argsort(self.tree.lo[out])]

    def _kept(self, items: np.ndarray, highest: np.ndarray) -> np.ndarray:
        """Item nodes whose bound with these documents reaches the weakest kth score in them."""
        if not len(items):
            return items
        places, sizes = self.maxima.at(items)
        bound = np.add.reduceat(self.maxima.value[places] * highest[self.maxima.term[places]], np.cumsum(sizes) - sizes)
        borders = np.column_stack([self.tree.lo[items], self.tree.hi[items]]).ravel()
        weakest = np.minimum.reduceat(self.kth, borders)[::2]
        self.bounds += len(items)
        return items[bound >= weakest]

    def _score(self, leaves: np.ndarray, own: np.ndarray, docs: Rows, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """Exact scores of single items and the documents of a leaf."""
        places, sizes = docs.at(own)
        terms, column = np.unique(docs.term[places], return_inverse=True)
        dense = np.zeros((len(own), len(terms) + 1), np.int64)  # the last column stands for all other terms
        dense[np.repeat(np.arange(len(own)), sizes), column] = docs.value[places]
        at = np.full(self.n_terms, len(terms))
        at[terms] = np.arange(len(terms))
        row = self.tree.lo[leaves]
        self.scored += len(row) * len(own)
        places, sizes = self.weighted.at(self.tree.order[row])
        score = np.add.reduceat(dense[:, at[self.weighted.term[places]]] * self.weighted.value[places], np.cumsum(sizes) - sizes, axis=1).T
        on = (score >= self.kth[row, None]).any(1)
        row, score = row[on], score[on]
        if not len(row):
            return
        score = np.where(score >= self.kth[row, None], score, 0)
        wide = lambda old, new: np.hstack([old[row], np.broadcast_to(new, score.shape)])
        s, i, u = np.hstack([self.scores[row], score]), wide(self.ids, ids[own]), wide(self.unnamed, unnamed[own])
        best = np.lexsort((i, u, -s), axis=-1)[:, : self.top]
        take = lambda x: np.take_along_axis(x, best, 1)
        self.scores[row], self.ids[row], self.unnamed[row] = take(s), take(i), take(u)
        self.kth[row] = np.maximum(self.kth[row], self.scores[row, -1])

    def found(self, number: np.ndarray) -> pa.RecordBatch:
        at, place = np.nonzero(self.scores > 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(number[self.tree.order[at]].astype(np.int32)), pa.array(self.ids[at, place], mask=self.unnamed[at, place]),
                pa.array(self.scores[at, place]),
            ],
            names=["number", "doc_id", "score"],
        )


# --- Spark ---------------------------------------------------------------------

_COUNTED = "block long, n_docs long, n_terms long, ids array<long>, lengths binary, start binary, term binary, times binary"


def _counted(docs: DataFrame, terms: dict[bytes, int], block_bytes: int) -> DataFrame:
    """Per block of documents: how often item terms occur in each, and the lengths of all."""

    def run(batches):
        block = first_block_id()
        for batch in batches:
            for lo, hi in block_spans(text_sizes(batch.column(1)), block_bytes):
                texts = [terms_of(t) for t in utf8(batch.column(1).slice(lo, hi - lo))]
                lengths = np.array([len(t) for t in texts], np.int64)
                number = np.concatenate([np.fromiter(map(terms.get, t, repeat(-1)), np.int64, len(t)) for t in texts])
                doc = np.repeat(np.arange(len(texts)), lengths)[number >= 0]
                key, times = np.unique(doc * len(terms) + number[number >= 0], return_counts=True)
                doc, term = np.divmod(key, max(1, len(terms)))
                held = np.bincount(doc, minlength=len(texts))
                on = np.flatnonzero(held)
                start = np.concatenate([[0], np.cumsum(held[on])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                        pa.array([batch.column(0).slice(lo, hi - lo).take(pa.array(on)).to_pylist()], pa.list_(pa.int64())),
                        *(pa.array([press(x.astype(k))], pa.binary()) for x, k in ((lengths[on], np.int64), (start, np.int64), (term, np.int32), (times, np.int32))),
                    ],
                    names=["block", "n_docs", "n_terms", "ids", "lengths", "start", "term", "times"],
                )
                block += 1

    return write_stage(docs.mapInArrow(run, _COUNTED), "counted")


def _frequencies(counted: DataFrame, n: int) -> np.ndarray:
    """Documents holding each of the item block's terms, summed per task before the shuffle."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for term in batch.column(0).to_pylist():
                total += np.bincount(unpress(term, np.int32), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    got = counted.select("term").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def _searched(counted: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, least: np.ndarray, top: int) -> DataFrame:
    """(number, doc_id, score): the best of every task for every item, from at least its kth score so far."""
    weighted = Rows(items.rows.start, items.rows.term, items.rows.value * weight[items.rows.term])
    tree = grow_tree(weighted, weight.astype(float), 1)
    maxima, number = node_maxima(tree, weighted), items.number

    def run(batches):
        search = Search(weighted, tree, maxima, len(weight), least, top)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, start = unpress(row["lengths"], np.int64), unpress(row["start"], np.int64)
                term, times = unpress(row["term"], np.int32).astype(np.int64), unpress(row["times"], np.int32).astype(np.int64)
                value = impacts(times, np.repeat(lengths, np.diff(start)), n_docs, n_terms)
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                search.show(ids, np.array([i is None for i in row["ids"]], bool), Rows(start, term, value), weight.astype(float))
        yield search.found(number)

    return counted.select("ids", "lengths", "start", "term", "times").mapInArrow(run, "number int, doc_id long, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_items(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
    block_bytes: int = BLOCK_BYTES,
    seed_share: int = SEED_SHARE,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    staged = blocks(items.coalesce(int(n_bytes // item_bytes) + 1), "text", item_bytes)
    out = []
    for (block,) in staged.select("block").collect():
        this = staged.where(F.col("block") == block)
        own = Items.of([(r["text"] or "").encode() for r in this.first()["rows"]])
        if not len(own.number):
            continue
        counted = _counted(docs, own.terms, block_bytes)
        n_docs, n_terms = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            break
        weight = item_weights(_frequencies(counted, len(own.terms)), n_docs)
        least = np.ones(len(own.number), np.int64)
        seeds = counted.where(F.pmod(F.xxhash64("block"), F.lit(seed_share)) == 0)
        place = {int(n): i for i, n in enumerate(own.number)}
        for r in _best(_searched(seeds, own, weight, n_docs, n_terms, least, top), top).where(F.col("rank") == top).collect():
            least[place[r["number"]]] = r["score"]
        best = _best(_searched(counted, own, weight, n_docs, n_terms, least, top), top)
        names = this.select(F.posexplode("rows").alias("number", "row")).select("number", F.col("row.item_id").alias("item_id"))
        out.append(best.join(names, "number").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
