"""A corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. STAGES lists them in order, run() applies them to the documents table, each result written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, prepare, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.ngram_join import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality
from tidemark.llm.suffix_dedup import suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    # a filter is pushed down into what it names, so the long expression of `kept` would be worked out many times over;
    # it is not pushed below a column that is not deterministic
    judged = quality(docs, carry=docs.columns).withColumn("_task", F.spark_partition_id())
    return judged.where("kept and _task >= 0").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    prepare(spark)
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur more than once; n_chars is that of the new text.

    A character that a removal cuts through becomes U+FFFD; a null text stays null.
    """
    prepare(spark)
    kept = suffix_dedup(docs, carry=docs.columns)
    text = F.when(F.col("carried.text").isNotNull(), F.make_valid_utf8(F.col("kept").cast("string")))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*(new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    prepare(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns).where("not contaminated").select("carried.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    prepare(spark)
    return pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packing),
]

#: Components, suffixes and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
