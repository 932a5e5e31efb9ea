"""Quality rules on tokenizer fertility, besides plain counts of words, lines and symbols.

A public byte-level vocabulary and a public piece vocabulary with byte fallback encode
every distinct word of a block of documents once; a document's characters per token,
byte-fallback share and token entropy follow from its word frequencies. The bands are
read off the whole corpus, per language, script and length: the middle of the class and how
far its inner half spreads. A text that costs far more or far fewer tokens than its language
usually does, falls back to bytes far more often, or says the same tokens over and over
is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.llm.blocks import block_spans, text_sizes
from fovea.llm.tokens import BYTE_BPE, PIECES, byte_bpe, sentence_pieces
from fovea.runtime import write_stage

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Band half-width in spreads of the inner half (as standard deviations of a normal law) of a text's language, script and size class.
BAND_SPREADS = 5.0
#: A class's middle and inner half count as many documents as it has, those of its language and script as this many, so that
#: a few odd texts of a rare size are no measure of themselves.
GROUP_WEIGHT = 50
#: A spread counts as this share of the middle at least, so that small or uniform groups keep a band.
MIN_SPREAD = 0.02
#: Token entropy below this share of the middle for the language and length is rejected.
ENTROPY_SHARE = 0.75
#: Byte-fallback shares up to this are never rejected.
FALLBACK_FREE = 0.2
#: Width of the classes in which metrics are counted.
CLASS_WIDTH = 0.01

BLOCK_BYTES = 8 << 20
METRICS = ["chars_per_token", "chars_per_piece", "fallback_share", "token_entropy"]
_FACTS = (
    "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, size_class int, chars_per_token double, chars_per_piece double, fallback_share double, token_entropy double"
)
# First code points of the blocks that decide a script; letters below the first are Latin.
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0, 0x10000, 0x1F000, 0x20000]
SCRIPT_NAMES = ["latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "devanagari", "other", "thai", "other", "latin", "greek", "none", "kana", "other", "han", "other", "hangul", "other", "other", "none", "han"]


def repeated_words(words: np.ndarray, document: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per word: is it in a ``width``-word window found twice or more in its document? Exact.

    ``words`` are word numbers, ``document`` ascending document numbers. Windows get numbers
    by pairing the numbers of their halves, so equal numbers mean equal words.
    """
    covered = np.zeros(len(words), bool)
    n = len(words) - width + 1
    if n < 1:
        return covered
    code, size = words.astype(np.int64), 1
    while size < width:
        left, right = code[: len(code) - size], code[size:]
        code = pd.factorize(left * (int(code.max()) + 1) + right)[0].astype(np.int64)
        size *= 2
    inside = document[:n] == document[width - 1 :]
    at = np.flatnonzero(inside)
    key = pd.factorize(document[at].astype(np.int64) * (int(code.max()) + 1) + code[at])[0]
    again = at[np.bincount(key)[key] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _script(chars: str) -> str:
    """Script of most letters of a text, by the ranges above; 'none' without letters.

    Punctuation, symbols and emoji have no script and do not vote.
    """
    points = np.frombuffer(chars.encode("utf-32-le"), "<u4")
    points = points[(points > 127) | ((points | 32) - 97 < 26)]
    if not len(points):
        return "none"
    counts = np.bincount(np.searchsorted(SCRIPT_STARTS, points, side="right") - 1, minlength=len(SCRIPT_STARTS))
    by_name: dict[str, int] = {}
    for name, n in zip(SCRIPT_NAMES, counts.tolist()):
        by_name[name] = by_name.get(name, 0) + n
    by_name.pop("none")
    return max(sorted(by_name), key=by_name.__getitem__) if any(by_name.values()) else "none"


def _block_facts(texts: list[str], vocabulary, pieces, is_byte: np.ndarray) -> pd.DataFrame:
    docs = len(texts)
    split = [t.encode().split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    flat = [w for ws in split for w in ws]
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(docs), lengths)
    out = pd.DataFrame({"n_words": lengths})
    out["word_chars"] = [len(t) - sum(map(t.count, WHITE)) for t in texts]
    out["n_symbols"] = [sum(map(t.count, SYMBOLS)) for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(WHITE)] for t in texts]
    out["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
    out["n_repeat_words"] = np.bincount(doc, repeated_words(word, doc), minlength=docs).astype(np.int64)
    out["script"] = [_script(t) for t in texts]

    spelled = [w.decode() for w in index]
    ids = [np.frombuffer(vocabulary.ids(" " + w), "<u4") for w in spelled]
    piece_ids = pieces.encode(spelled, num_threads=1) if spelled else []
    n_ids = np.array([len(i) for i in ids], np.int64)
    n_pieces = np.array([len(p) for p in piece_ids], np.int64)
    n_bytes = np.array([int(is_byte[p].sum()) for p in piece_ids], np.int64)
    tokens = np.bincount(doc, n_ids[word], minlength=docs) if len(word) else np.zeros(docs)
    piece_sum = np.bincount(doc, n_pieces[word], minlength=docs) if len(word) else np.zeros(docs)
    byte_sum = np.bincount(doc, n_bytes[word], minlength=docs) if len(word) else np.zeros(docs)

    entropy = np.zeros(docs)
    if len(word):
        # (document, word) frequencies first, then the tokens of each distinct word once
        key, times = np.unique(doc * len(index) + word, return_counts=True)
        owner, which = key // len(index), key % len(index)
        starts = np.concatenate([[0], np.cumsum(n_ids)])
        reach = n_ids[which]
        place = np.repeat(starts[which] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
        code = np.repeat(owner, reach) << 32 | np.concatenate(ids)[place].astype(np.int64)
        group, each = pd.factorize(code)
        weight = np.bincount(group, np.repeat(times, reach))
        at = each >> 32
        entropy = np.log2(np.maximum(tokens, 1)) - np.bincount(at, weight * np.log2(weight), minlength=docs) / np.maximum(tokens, 1)
    some = np.maximum(tokens, 1)
    out["size_class"] = np.floor(np.log2(some)).astype(np.int32)
    out["chars_per_token"] = out["word_chars"] / some
    out["chars_per_piece"] = out["word_chars"] / np.maximum(piece_sum, 1)
    out["fallback_share"] = byte_sum / np.maximum(piece_sum, 1)
    out["token_entropy"] = entropy
    return out


def word_facts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """Staged counts and fertility metrics of every row; null texts have none of anything."""

    def count(batches):
        v, pieces = byte_bpe(vocabulary), sentence_pieces(piece_vocabulary)
        is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        names = [c.split()[0] for c in _FACTS.split(", ")]
        for batch in batches:
            for lo, hi in block_spans(text_sizes(batch.column(1)), BLOCK_BYTES):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                facts = _block_facts(texts, v, pieces, is_byte)
                own = {"doc_id": batch.column(0).slice(lo, hi - lo), "lang": batch.column(2).slice(lo, hi - lo)}
                yield pa.RecordBatch.from_arrays([own[n] if n in own else pa.array(facts[n]) for n in names], names=names)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return write_stage(docs.mapInArrow(count, _FACTS), "facts")


def _quantiles(facts: DataFrame, keys: list[str], metric: str, shares: list[float]) -> DataFrame:
    """Quantiles of ``metric`` per group over all rows, to CLASS_WIDTH.

    Counted in classes, so that the result is the same in any order and no group is sorted.
    """
    classes = facts.groupBy(*keys, F.floor(F.col(metric) / CLASS_WIDTH).alias("__class")).count()
    group = Window.partitionBy(*keys)
    share = F.sum("count").over(group.orderBy("__class")) / F.sum("count").over(group)
    ranked = classes.withColumn("__share", share)
    return ranked.groupBy(*keys).agg(
        *[(F.min(F.when(F.col("__share") >= q, F.col("__class"))) * CLASS_WIDTH).alias(f"__{metric}_{i}") for i, q in enumerate(shares)]
    )


def _same(left: list[str], right: DataFrame) -> tuple[DataFrame, Column]:
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") if c in left else F.col(c) for c in right.columns])
    on = None
    for c in left:
        equal = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        on = equal if on is None else on & equal
    return renamed, on


def fertility_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str = BYTE_BPE,
    piece_vocabulary: str = PIECES,
) -> DataFrame:
    """Base counts, the four metrics, their bands' verdict and ``kept`` for every row.

    Null and empty texts have zero words and fail the base rule. A null language is a group
    of its own; a group of one document is its own middle and keeps it. Repeated rows are
    judged each. Other columns are not read.
    """
    facts = word_facts(docs, id_col, text_col, lang_col, vocabulary, piece_vocabulary)
    n_words, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    judged = facts.withColumn("base_failed", failed)
    sound = judged.where(~F.col("base_failed"))
    keys = ["lang", "script"]
    length_keys = [*keys, "size_class"]
    classes = sound.groupBy(*length_keys).agg(F.count(F.lit(1)).alias("__n"))
    for metric in METRICS[:3]:
        shares = [0.25, 0.5, 0.75]
        bands, on = _same(keys, _quantiles(sound, keys, metric, shares))
        judged = judged.join(bands, on, "left").drop(*[f"__k_{k}" for k in keys])
        own = _quantiles(sound, length_keys, metric, shares).toDF(*length_keys, *[f"__own_{metric}_{i}" for i in range(3)])
        bands, on = _same(length_keys, own)
        judged = judged.join(bands, on, "left").drop(*[f"__k_{k}" for k in length_keys])
    bands, on = _same(length_keys, classes)
    judged = judged.join(bands, on, "left").drop(*[f"__k_{k}" for k in length_keys])
    floor_, on = _same(length_keys, _quantiles(sound, length_keys, "token_entropy", [0.5]))
    judged = judged.join(floor_, on, "left").drop(*[f"__k_{k}" for k in length_keys])

    def band(metric):
        # scatter over few tokens is in the class's own inner half
        low, mid, high = (
            (F.col("__n") * F.col(f"__own_{metric}_{i}") + GROUP_WEIGHT * F.col(f"__{metric}_{i}")) / (F.col("__n") + GROUP_WEIGHT) for i in range(3)
        )
        return mid, BAND_SPREADS * F.greatest((high - low) / 1.349, MIN_SPREAD * mid)

    rejected = F.lit(False)
    for metric in METRICS[:2]:
        mid, width = band(metric)
        rejected = rejected | (F.abs(F.col(metric) - mid - CLASS_WIDTH / 2) > width)
    mid, width = band("fallback_share")
    rejected = rejected | (F.col("fallback_share") > F.greatest(F.lit(FALLBACK_FREE), mid + width))
    rejected = rejected | (F.col("token_entropy") < ENTROPY_SHARE * F.col("__token_entropy_0"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS
    )
