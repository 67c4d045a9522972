"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from retentia.llm.exact_dedup import deduplicate
from retentia.llm.jaccard_join import keep_one_per_group
from retentia.llm.packing import pack
from retentia.llm.store import written
from retentia.llm.toxicity import fit_toxicity, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on these documents
    and the training part of their labels."""
    return keep_clean(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays (five-word
    shingles, Jaccard similarity of 0.8 or more)."""
    return keep_one_per_group(docs, words=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, packed into sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("packing", packing),
]

#: Weak supervision, similarity links and the packing plan have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is
    written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), re.sub(r"\W+", "_", name))
    return STAGES[-1][1](spark, docs, sf_dir)
