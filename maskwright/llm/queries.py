"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import chat_format, cotraining, decontaminate, exact_dedup, jaccard_join, language_id, packing, secret_scan, substring_dedup, warc
from maskwright.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "path", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.preferences(table(spark, sf_dir, "conversations"))
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_spans", chat_format.spans_text(f"{side}_spans"))
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_preference_format": op7_preference_format,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
}
