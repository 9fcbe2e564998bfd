"""From documents to training sequences: toxicity, quality rules, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``. Null texts count as empty: they are not toxic, fail the
quality rules and so never reach the later stages. Rows with the same id and text are judged alike and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm import neardup, packing, quality, toxicity
from tallyflow.llm.shipping import ship
from tallyflow.runtime import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more on five-word shingles stays."""
    ship(spark)
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]
#: The first stages learn from labels: no SQL tells their result; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
