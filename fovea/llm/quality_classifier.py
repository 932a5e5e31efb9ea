"""A quality classifier made of two compression dictionaries.

One zstandard dictionary is built from good labelled text, one from bad. Every piece of
a text is compressed with both; what the difference of the sizes is of their sum says
which kind the piece resembles. Three such figures (whole text, the piece most like bad
text, share of text in pieces nearer to bad text) go through a logistic curve fitted on
labelled documents that no dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.llm.blocks import utf8
from fovea.runtime import write_stage

#: Labelled documents per class that a fit uses at most, chosen by the hash of their id.
SAMPLE_DOCS = 8_000
#: Pieces per class that a dictionary is built from at most.
SAMPLE_PIECES = 6_000
#: Bytes per piece; small, so that the dictionary and not the text itself does the work.
PIECE_BYTES = 512
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
# Fixed values of the held-out fold.
FOLDS, HELD_OUT = 5, 0
RIDGE = 0.01


@dataclass(frozen=True)
class QualityModel:
    """What a fit keeps: two dictionaries and the logistic curve; tens of kilobytes."""

    good: bytes
    bad: bytes
    trained: tuple[bool, bool]
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        kinds = [zstandard.DICT_TYPE_FULLDICT if t else zstandard.DICT_TYPE_RAWCONTENT for t in self.trained]
        out = []
        for data, kind in zip((self.good, self.bad), kinds):
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=kind) if data else None
            out.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
            )
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.mean)) / np.array(self.spread)
        return 1.0 / (1.0 + np.exp(-np.clip(np.c_[z, np.ones(len(z))] @ np.array(self.weights), -500, 500)))


def pieces_of(text: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    """The whole text in pieces; the empty text is one empty piece."""
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def size_features(texts: list[bytes], compressors) -> np.ndarray:
    """Three normalised size differences per text; positive where good text is nearer."""
    good, bad = compressors
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        pieces = pieces_of(text)
        a = np.array([len(good.compress(p)) for p in pieces], float)
        b = np.array([len(bad.compress(p)) for p in pieces], float)
        weight = np.array([len(p) for p in pieces], float) + 1.0
        each = (b - a) / (a + b)
        out[i] = (b.sum() - a.sum()) / (a.sum() + b.sum()), each.min(), weight[each < 0].sum() / weight.sum()
    return out


def _dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary; with too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), True
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES], False


def _logistic(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread[spread == 0] = 1.0
    x = np.c_[(features - mean) / spread, np.ones(len(features))]
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (label - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, spread


def held_out(id_: Column) -> Column:
    """Is the row in the fold that no fit sees? A null id is."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
    sample_pieces: int = SAMPLE_PIECES,
) -> QualityModel:
    """Fit on labelled rows outside the held-out fold.

    At most ``sample_docs`` documents per class and ``sample_pieces`` pieces of 512 bytes per
    class are used; both bounds are parameters and everything that reaches the driver is
    within them. Half of the sample makes the dictionaries, the other half the curve,
    weighted so that the classes count as they do among all labels. An id labelled twice
    counts as bad if any label says so. Without labels of both classes every score is the
    share of good ones, or 0.5.
    """
    marked = (
        labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .where(F.col("__label").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"))
    )
    totals = {r["__label"]: r["count"] for r in marked.groupBy("__label").count().collect()}
    if len(totals) < 2:
        share = 0.5 if not totals else 0.01 + 0.98 * (1 in totals)
        return QualityModel(b"", b"", (False, False), (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))), (0.0,) * 3, (1.0,) * 3)
    order = F.xxhash64("__id")
    chosen = None
    for label in (0, 1):
        part = marked.where(F.col("__label") == label).orderBy(order, "__id").limit(sample_docs)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # at most 2 * sample_docs rows of two numbers, whatever the corpus holds; a repeated id stands for one document
    labelled = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    sample = write_stage(labelled, "labelled").withColumn("__half", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)))

    def cut(batches):
        for batch in batches:
            for i, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                parts = pieces_of(text)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array([label] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())],
                    names=["__id", "__label", "__pos", "__piece"],
                )

    parts = sample.where("__half = 0").select("__id", "__label", "__text").mapInArrow(cut, "__id long, __label int, __pos int, __piece binary")
    dictionaries = []
    for label in (1, 0):
        rows = parts.where(F.col("__label") == label).orderBy(F.xxhash64("__id", "__pos"), "__id", "__pos").limit(sample_pieces).collect()
        dictionaries.append(_dictionary([bytes(r["__piece"]) for r in rows]))
    (good, good_trained), (bad, bad_trained) = dictionaries
    model = QualityModel(good, bad, (good_trained, bad_trained), (0.0,) * 4, (0.0,) * 3, (1.0,) * 3)

    def measure(batches):
        compressors = model.compressors()
        for batch in batches:
            f = size_features(utf8(batch.column(1)), compressors)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f[:, k]) for k in range(3)]], names=["__label", "a", "b", "c"])

    rows = sample.where("__half = 1").select("__label", "__text").mapInArrow(measure, "__label int, a double, b double, c double").collect()
    rows = sorted(tuple(r) for r in rows)
    label = np.array([r[0] for r in rows], float)
    if len(set(label)) < 2:
        share = totals[1] / (totals[0] + totals[1])
        return QualityModel(good, bad, model.trained, (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))), (0.0,) * 3, (1.0,) * 3)
    weight = np.where(label == 1, totals[1] / (label == 1).sum(), totals[0] / (label == 0).sum())
    w, mean, spread = _logistic(np.array([r[1:] for r in rows]), label, weight * len(label) / weight.sum())
    return QualityModel(good, bad, model.trained, tuple(w.tolist()), tuple(mean.tolist()), tuple(spread.tolist()))


def quality_score(text: Column, model: QualityModel) -> Column:
    """Score of a text from 0 to 1, higher for better; null counts as empty and gets the empty text's score."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        features = size_features([t.encode() if t is not None else b"" for t in texts], model.compressors())
        return pd.Series(model.scores(features))

    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` up) for every row, repeated ones too.

    Only the text decides a score. Other columns are not read; an empty table gives no rows.
    """
    model = fit_quality(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), quality_score(F.col(text_col), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    model = fit_quality(docs, labels, id_col, text_col)
    return docs.where(quality_score(F.col(text_col), model) >= threshold)
