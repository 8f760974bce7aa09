"""The corpus pipeline: documents in, packed training sequences out.

Nulls, empty and repeated rows, clashing column names and empty tables have the results
that each stage's operator states: a null text fails the quality rules; of several rows of
one id the near-duplicate stage keeps one; an empty table gives an empty result.

Each stage works on all rows that the one before it kept, and ``run`` writes a stage's
rows as Parquet to the shared folder before the next one reads them, so a lost executor
never costs more than a stage.  All stages but the last return the columns of
``documents``; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import jaccard_join, line_dedup, packing, quality_rules, suffix_dedup
from tidemill.llm.common import materialize, release, table

#: A string that repeats goes from this many bytes on: passages of fifty words are longer.
PASSAGE = 200


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document or place has go; so do documents with nothing else."""
    return _counted(line_dedup.keep_unseen(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that occur twice or more go, all their copies; so do documents with nothing else."""
    return _counted(suffix_dedup.keep_unrepeated(docs, length=PASSAGE))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and token-budget batches."""
    return packing.pack_texts(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("suffix_dedup", repeats), ("packing", pack)]

#: Near duplicates and suffix arrays are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
