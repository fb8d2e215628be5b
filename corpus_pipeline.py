"""Cleaning and packing of a document corpus for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and all of what the stage before it kept; all but
the last return the columns of ``documents``.  Stages are separated by Parquet tables in
the shared folder, so a lost executor costs no more than the stage it was lost in; a table
goes when the next one is written, and only the last, which the result reads, stays.

Defined results: an empty table stays empty through all stages; without labels the classifier
scores all documents alike, at a half, and none is kept; each stage says what it does with
nulls, empty and long texts, ties and repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetric.llm import exact_dedup, near_dedup, pii, quality
from trailmetric.llm.common import remove, shared_folder, strict, table
from trailmetric.llm.queries import held_out, packed

KEEP_SCORE = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ``KEEP_SCORE`` go.

    Null and empty texts have the score of no feature at all; rows of a null or repeated id are scored by their own texts.
    """
    labels = strict(table(spark, sf_dir, "labels"), "doc_id", "quality").filter(~held_out(4, 2))
    model = quality.train(docs, labels)
    return quality.score(docs, model).filter(F.col("score") >= KEEP_SCORE).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest original, of equals the smallest id.

    Null, empty and blank texts are one group; of rows alike in id and text one stays.
    """
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, 0.8) stays: the smallest id.

    Texts without words are linked with nothing and stay; rows of one id, or none, and unlike texts each have their own fate.
    """
    return near_dedup.deduplicate(docs, size=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts; n_chars, where there is one, follows. Rows, null texts among them, all stay."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens; a null or empty text is its end id alone."""
    return packed(strict(docs, "doc_id", "text"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, f"{folder}/{done}")
        done = name
    return docs
