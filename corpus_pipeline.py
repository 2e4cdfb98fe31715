"""A corpus pipeline: quality, rules, near-duplicates, mixing and encoding, each stage over all that the last one kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quayside.llm import mixing, pieces, quality, repetition, simhash
from quayside.llm.common import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model rejects go; it learns from those of `docs` that are labelled.

    A null or empty text is one empty line, a null id has no label, equal rows stay or
    go together, and with no labels of both classes or no rows nothing is rejected.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts, and those that repeat themselves; equal rows stay or go together."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Equal rows are one document; texts without a word are equal.  Rows of one id with
    other texts are other documents; a row without an id stays if its group has none
    with one.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go or repeat as the sources' targets ask; null is a source, a text without words comes once, and equal rows are as many documents."""
    return mixing.repeat_by_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document: doc_id, ids, n_tokens, round_trip; a null text has null ids, an empty one none."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the line model nor XXH64 fingerprints, so brute force tests the stages.
ORACLE_SQL = None


def _shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pipeline-")
    return f"{named}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs, folder = read_table(spark, sf_dir, "documents"), _shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
