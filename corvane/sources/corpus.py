"""documents -> lines -> paragraphs -> sentences: the corpus views that the text queries share.

A paragraph is a line that isn't blank; 20 lines make a page. Offsets are running sums within a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.text import sentences as split_sentences

LINES_PER_PAGE = 20
ORDER = ("page_num", "char_offset_start", "id")


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, source, pos, page_num, paragraph_id, para; narrow, without a shuffle."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "para")).filter(F.col("para").rlike(r"\S"))
    page = F.floor(F.col("pos") / LINES_PER_PAGE).cast("int") + 1
    return lines.select("doc_id", "source", "pos", page.alias("page_num"), F.concat(F.lit("p"), page, F.lit("_para"), F.col("pos") % LINES_PER_PAGE + 1).alias("paragraph_id"), "para")


def sentences(documents: DataFrame) -> DataFrame:
    """id, doc_id, source, page_num, paragraph_id, sentence_id, text, char_offset_start, char_offset_end,
    item_type. One shuffle, by page, and only where offsets are read."""
    each = paragraphs(documents).select("doc_id", "source", "pos", "page_num", "paragraph_id", F.posexplode(split_sentences(F.col("para"))).alias("k", "text"))
    sid = F.concat("paragraph_id", F.lit("_s"), F.col("k") + 1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy("doc_id", "page_num").orderBy("pos", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return each.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_"), sid).alias("id"),
        "doc_id",
        "source",
        "page_num",
        "paragraph_id",
        sid.alias("sentence_id"),
        "text",
        start.alias("char_offset_start"),
        (start + F.length("text")).alias("char_offset_end"),
        F.lit("paragraph").alias("item_type"),
    )
