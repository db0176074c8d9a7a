"""One query per operator over its whole table, and the pipeline; SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ngram_join import ngram_jaccard
from . import chat, decontaminate, maxent_lm, packing, suffix_dedup, wavelet
from . import quality as rules
from . import url_filter as urls
from . import warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), size=5, percent=80).select("doc_id", "n_shingles", "component_id", "n_class")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=2048, end=0, with_ids=False).drop("ids")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance: one row for each item found in a document."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("finds").alias("f")).select("doc_id", "f.item_id", "f.distance")


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_round_trip(table(spark, sf_dir, "documents"), end=2)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept", "carried")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_chats(chat.with_added(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_best_fit": op2_best_fit,
    "op3_decontaminate": op3_decontaminate,
    "op4_wavelet": op4_wavelet,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_maxent": op8_maxent,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat": op10_chat,
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": urls.SQL,
    "op6_quality": rules.SQL,
    "op7_warc": warc.SQL,
    "op10_chat": chat.SQL,
}
