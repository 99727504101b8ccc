"""A corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes the documents that its predecessor kept, from Parquet, and its decisions take effect: all but the last
return documents with their columns, the last returns the placement of their pieces in sequences.

Defined cases, of every stage: an empty table gives an empty one. Rows without a doc_id, or with one that others have, are
told apart by their texts. Texts of any length are taken whole. Columns beside those of documents, whatever their names,
are handed on by all but the last. What a stage does with a null or empty text, with ties and with repeated rows is said
at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import cotraining, decontaminate, exact_dedup, jaccard_join, packing
from maskwright.llm.common import materialize, table
from maskwright.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects: low quality, or toxic.

    A null or empty text has the features of no words. A score that equals the threshold stays. Rows that repeat id and
    text stay together where all are accepted; where their metadata makes only some of them so, one of them stays.
    """
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, blanks aside.

    That with the least doc_id stays, one without an id only where all are; null and empty texts are one text. Of rows that
    repeat id and text one stays.
    """
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more.

    That with the least doc_id stays, one without an id only where all are; texts without words, null among them, are one
    group. Of rows that repeat id and text one stays.
    """
    return jaccard_join.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item.

    A null or empty text holds none, so it stays. Each row goes or stays by its own text, repeated rows alike.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences.

    A null or empty text is its end id alone. Pieces of equal length are placed in any order; repeated rows are packed each.
    """
    return packing.best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", clean),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
