"""The corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage gets the table that the one before it wrote and works on all of it. The first three return
the columns of documents; the last returns one row a piece of a packed sequence.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table (its result
is empty) and extra columns of any name, which the first three keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import released, written
from corvane.llm.near_dedup import first_of_each
from corvane.llm.packing import packed
from corvane.llm.pii import revealing_terms, sanitised
from corvane.llm.quality_rules import kept_documents

JACCARD = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, repeated rows each. A null or empty text has no words and goes."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id. Near copies are texts of
    five-word similarity 0.8 or more, and those that op7 links. Rows that repeat an id and a text are one; a null
    doc_id comes after all others, and of one id the text of the smaller digest is kept. Texts without
    words are copies of each other."""
    return first_of_each(docs, jaccard=JACCARD)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data and without terms that reveal it; their
    n_chars follows. A null text stays null; repeated rows are treated each, and are one text as evidence."""
    return sanitised(docs, revealing_terms(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. A null or empty text is one piece, its end id; repeated rows are packed each."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Token ids and fingerprints can't be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        released(spark, before)
    return docs
