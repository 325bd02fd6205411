"""Context around sentences: windows, whole paragraphs, everything before a paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def in_document():
    """Reading order of a document."""
    return W.partitionBy("doc_id").orderBy("page_num", "char_offset_start", "id")


def context_windows(sentences: DataFrame, targets: DataFrame, size: int = 2) -> DataFrame:
    """For each target (target_id, doc_id) the sentences at most `size` places away in reading order.

    Ranks are taken only within documents that hold a target; the join is by doc_id and range.
    """
    ranked = sentences.join(targets.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("rn", F.row_number().over(in_document()))
    at = targets.join(ranked.select(F.col("id").alias("target_id"), F.col("rn").alias("target_rn")), "target_id")
    near = ranked.join(at, "doc_id").filter(F.col("rn").between(F.col("target_rn") - size, F.col("target_rn") + size))
    return near.select("target_id", *sentences.columns, "rn")


def paragraph_contexts(sentences: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (target_id, doc_id, paragraph_id) all sentences of its paragraph."""
    return targets.select("target_id", "doc_id", "paragraph_id").join(sentences, ["doc_id", "paragraph_id"])


def assembled_paragraphs(sentences: DataFrame) -> DataFrame:
    """doc_id, paragraph_id, page_num, text (sentences joined by a space in reading order), rank in the document."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "char_offset_start", "id", "text"))), lambda x: x["text"]), " ")
    joined = sentences.groupBy("doc_id", "paragraph_id").agg(F.min("page_num").alias("page_num"), F.min("char_offset_start").alias("start"), text.alias("text"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "start", "paragraph_id"))
    return joined.select("doc_id", "paragraph_id", "page_num", "text", rank.alias("rank"))


def paragraphs_of_sentences(sentences: DataFrame, by: tuple[str, ...] = ("doc_id", "paragraph_id")) -> DataFrame:
    """by, text (as assembled_paragraphs), ids (of the paragraph's sentences): each sentence is sorted into its paragraph
    once and joined to nothing. Where paragraphs lie in pages, by may hold page_num, so rows dealt by page stay there."""
    own = sentences.filter(F.col("doc_id").isNotNull() & F.col("paragraph_id").isNotNull())
    grouped = own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("page_num", "char_offset_start", "id", "text"))).alias("own"))
    return grouped.select(*by, F.array_join(F.col("own.text"), " ").alias("text"), F.col("own.id").alias("ids"))


def preceding_paragraphs(sentences: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (doc_id, target_paragraph) the paragraphs up to it, itself included."""
    paras = assembled_paragraphs(sentences.join(targets.select("doc_id").distinct(), "doc_id", "left_semi"))
    at = paras.select("doc_id", F.col("paragraph_id").alias("target_paragraph"), F.col("rank").alias("target_rank")).join(targets, ["doc_id", "target_paragraph"])
    return paras.join(at, "doc_id").filter("rank <= target_rank").select("target_paragraph", *paras.columns)


def all_windows(sentences: DataFrame, size: int = 2) -> DataFrame:
    """For every sentence: id, n, context (the texts at most `size` places away, joined); a window frame, no join."""
    around = in_document().rowsBetween(-size, size)
    return sentences.select("id", F.count(F.lit(1)).over(around).alias("n"), F.array_join(F.collect_list("text").over(around), " ").alias("context"))
