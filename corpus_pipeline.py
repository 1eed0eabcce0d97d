"""From raw documents to packed training windows: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm.exact_dedup import drop_copies
from chorale.llm.jaccard_join import drop_near_copies
from chorale.llm.language_id import held_out, keep_languages, learn_with_floors
from chorale.llm.packing import pack_documents
from chorale.llm.quality import keep_quality
from chorale.llm.shared import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach; other languages, noise and texts without a letter go.

    Null and empty texts have no letter. Rows that repeat stay or go together. Whole texts are read, of any
    length. Without labelled documents, and for an empty table, nothing stays.
    """
    profiles, least = learn_with_floors(docs.where(~held_out(F.col("doc_id"))))
    return keep_languages(docs, profiles, least=least)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that no quality rule rejects, on their whole texts.

    Null and empty texts have no words and go; rows that repeat stay or go together; an empty table stays empty.
    """
    return keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of texts that are equal but for white space: the smallest doc_id, null last.

    Null counts as an empty text; of rows that repeat doc_id and text one stays; an empty table stays empty.
    """
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of documents connected by a similarity of 0.8 or more over five-word shingles.

    The smallest doc_id stays, null last. Texts without words are alike; a shorter text is one shingle; an
    empty table stays empty.
    """
    return drop_near_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 words; longer documents are cut into pieces, none is dropped.

    A document without words has one piece of no words; a null source conflicts with no other; an empty table
    gives no pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

#: Language profiles and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
