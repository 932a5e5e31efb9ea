"""The training-data pipeline: five stages over ``documents``, each written before the next reads it.

Quality classifier (documents it rejects go), exact deduplication, near-duplicate
detection (one document of each group stays), substring deduplication (duplicate spans
leave the text), best-fit packing (the last stage, one row per piece).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.llm import exact_dedup, near_dedup, packing, quality_classifier, substring_dedup
from fovea.llm.queries import GOOD_SCORE, SEQUENCE_TOKENS, table
from fovea.runtime import drop_stages, write_stage, written_stages

_scratch: list[str] = []  # folders the stage called last works in


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on ``labels``, does not reject."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), GOOD_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near-duplicates, the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 13-word runs that a document with a smaller id also has."""
    left = substring_dedup.drop_duplicate_spans(docs)
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, SEQUENCE_TOKENS)


def _cleaning(stage):
    """The stage, after deleting what the stage before it worked in.

    By then its result has been written and ``docs`` reads that, so a run never keeps the
    scratch tables of more than one stage.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stages(spark, _scratch)
        before = set(written_stages())
        out = stage(spark, docs, sf_dir)
        _scratch[:] = [folder for folder in written_stages() if folder not in before]
        return out

    return run_stage


STAGES = [
    ("quality classifier", _cleaning(quality)),
    ("exact dedup", _cleaning(exact)),
    ("MinHash near-dedup", _cleaning(near)),
    ("substring dedup", _cleaning(substrings)),
    ("best-fit packing", _cleaning(packed)),
]

#: Compression sizes, signatures and tokens are outside SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written as Parquet and reread as the next one's input."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop_stages(spark, read)
        read = written_stages()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
