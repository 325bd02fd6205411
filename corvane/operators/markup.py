"""Canonical page markup: parse to items, flatten to rows, render back. Windows only, no UDF.

A line that is a marker opens a block; [SECTION] closes the open one, and its own lines are dropped.
Lines before any marker belong to no block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.text import is_figure_caption, is_metadata_line, trimmed, without_metadata

# The markers and what they open.
MARKERS = {"[PARAGRAPH]": "paragraph", "[DISPLAY_MATH]": "display_math", "[TABLE]": "table", "[FIGURE]": "figure", "[SECTION]": "section"}
SHORT_NAMES = {"paragraph": "para", "display_math": "math", "table": "table", "figure": "fig"}
IMAGE = r"^!\[([^\]]*)\]\(([^)]*)\)$"
SHORTEST_ROW = 10


def parsed(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, markup) -> items: doc_id, page_num, block, item_type, item_id, content, page_start."""
    lines = pages.select("doc_id", "page_num", F.posexplode(F.split("markup", "\n")).alias("pos", "line"))
    kinds = F.create_map(*(F.lit(x) for pair in MARKERS.items() for x in pair))
    opened = F.element_at(kinds, trimmed(F.col("line")))
    page = W.partitionBy("doc_id", "page_num")
    own = lines.withColumn("opens", opened).withColumn("block", F.sum(F.when(F.col("opens").isNotNull(), 1).otherwise(0)).over(page.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("opens").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    blocks = own.filter("block > 0").groupBy("doc_id", "page_num", "block").agg(F.max("opens").alias("opened"), trimmed(body).alias("content")).filter("content <> '' and opened <> 'section'")
    kind = F.when((F.col("opened") == "display_math") & is_figure_caption(F.col("content")), "figure").otherwise(F.col("opened"))
    blocks = blocks.withColumn("item_type", kind)
    number = F.row_number().over(W.partitionBy("doc_id", "page_num", "item_type").orderBy("block"))
    short = F.element_at(F.create_map(*(F.lit(x) for pair in SHORT_NAMES.items() for x in pair)), F.col("item_type"))
    start = F.coalesce(F.sum(F.length("content") + 1).over(page.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.select("doc_id", "page_num", "block", "item_type", F.concat(F.lit("p"), "page_num", F.lit("_"), short, number.cast("string")).alias("item_id"), "content", start.cast("int").alias("page_start"))


def flattened(items: DataFrame) -> DataFrame:
    """Items to sentence rows: a paragraph's lines are its sentences, any other item is one row at offset 0."""
    paras = items.filter("item_type = 'paragraph'").select("doc_id", "page_num", "item_id", "page_start", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    text = trimmed(F.col("line"))
    paras = paras.select("doc_id", "page_num", F.col("item_id").alias("paragraph_id"), F.concat("item_id", F.lit("_s"), (F.col("k") + 1).cast("string")).alias("sentence_id"), text.alias("text"), "page_start", "k").filter("text <> ''")
    before = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy("doc_id", "paragraph_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    paras = paras.withColumn("char_offset_start", (F.col("page_start") + before).cast("int")).withColumn("item_type", F.lit("paragraph")).drop("page_start", "k")
    figure = F.when(F.col("content").rlike(IMAGE), F.regexp_extract("content", IMAGE, 1)).otherwise(F.col("content"))
    rest = items.filter("item_type <> 'paragraph'").select(
        "doc_id", "page_num", F.col("item_id").alias("paragraph_id"), F.col("item_id").alias("sentence_id"), F.when(F.col("item_type") == "figure", figure).otherwise(F.col("content")).alias("text"), F.lit(0).alias("char_offset_start"), "item_type"
    )
    both = paras.unionByName(rest)
    return both.select(F.concat(F.col("doc_id").cast("string"), F.lit("_"), "sentence_id").alias("id"), "doc_id", "page_num", "paragraph_id", "sentence_id", "text", "char_offset_start", (F.col("char_offset_start") + F.length("text")).cast("int").alias("char_offset_end"), "item_type")


def cleaned(rows: DataFrame) -> DataFrame:
    """Rows without metadata lines; what is shorter than SHORTEST_ROW after that goes. Offsets stay."""
    return rows.withColumn("text", without_metadata(F.col("text"))).filter(F.length(trimmed(F.col("text"))) >= SHORTEST_ROW)


def rendered(items: DataFrame) -> DataFrame:
    """doc_id, text: items in order for reading, a blank line after each."""
    body = (
        F.when(F.col("item_type") == "paragraph", F.regexp_replace("content", r"\s*\n\s*", " "))
        .when((F.col("item_type") == "display_math") & ~F.col("content").startswith("$$"), F.concat(F.lit("$$\n"), "content", F.lit("\n$$")))
        .when((F.col("item_type") == "figure") & ~F.col("content").rlike(IMAGE), F.concat(F.lit("!["), "content", F.lit("]()")))
        .otherwise(F.col("content"))
    )
    parts = F.transform(F.sort_array(F.collect_list(F.struct("page_num", "block", body.alias("body")))), lambda x: x["body"])
    return items.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("text"))


def boilerplate(lines: DataFrame, line_col: str = "line") -> DataFrame:
    return lines.filter(is_metadata_line(F.col(line_col)))
