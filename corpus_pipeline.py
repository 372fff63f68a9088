"""From raw documents to packed training sequences, as stages that each work on what the one before kept.

Toxic documents go, then those that the quality rules reject, then all but one of each group of near-duplicates; the rest is mixed to
target weights of its sources (a small source may come more than once) and packed into sequences of 1,024 tokens.

Defined cases: a null or empty text has no words, so the quality rules reject it; a text of any length is worked on whole; rows that share a
doc_id, and equal rows, leave one row at near-duplicates, as do rows without a doc_id that have one text; ties there go to the least doc_id; a null
source is a source of its own; an empty table gives an empty result; other columns stay up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import mixing, neardup, packing, quality_rules, toxicity
from quillspark.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't predict toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return quality_rules.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of a mixture by tempered source sizes."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(packing.digest(packing.pieces(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Near-duplicate components, learned scores and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
