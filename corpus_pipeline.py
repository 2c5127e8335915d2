"""The corpus pipeline: documents by language, one of each group of near copies, without PII, mixed to
target weights, encoded. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import langid, minhash, mixing, nbest, surrogate
from marlstone.llm.shared import dropped, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays in doubt, go."""
    return langid.screened(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: 5-word shingles, similarity 0.8 or more."""
    return minhash.deduplicated(docs, words=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII in the texts becomes surrogates."""
    return surrogate.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each document, the best scores, and whether the ids decode to it."""
    return nbest.encoded(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("PII", pii),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the language model nor the segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)  # nothing reads it any more: what follows reads the table just written
    return STAGES[-1][1](spark, docs, sf_dir)
