"""Hybrid and fast search over both indexes, and the cumulative context of their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.text import content_type, table_caption
from corvane.operators import bm25, context, fusion, vector
from corvane.operators.plugins import Embedder, Scorer, embedded, reranked
from corvane.sources.shared import written


def candidate_count(k: int, fast: bool = False) -> int:
    return max(4 * k, 20) if fast else max(2 * k, 10)


def fetch_count(k: int) -> int:
    return 2 * candidate_count(k)


def fused(vector: DataFrame, keyword: DataFrame, method: str = "weighted", alpha: float = 0.5, k: int | None = None) -> DataFrame:
    if method == "rrf":
        return fusion.reciprocal_rank(vector, keyword, k=k)
    if method != "weighted":
        raise ValueError(f"no fusion named {method}")
    return fusion.weighted(vector, keyword, alpha, k)


def hybrid_search(vector: DataFrame, keyword: DataFrame, items: DataFrame, queries: DataFrame, k: int = 3, alpha: float = 0.5, method: str = "weighted", scorer: Scorer | None = None) -> DataFrame:
    """query_id, id, text, score, rank: fuse, cut to the candidates, join their texts (hits without one go), rerank.

    items: (id, text), text being the whole paragraph of a sentence or the whole document.
    """
    top = written(items.sparkSession, fused(vector, keyword, method, alpha, candidate_count(k)), "search-hits")  # a few rows a query
    found = top.join(items.select("id", "text"), "id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return reranked(found.withColumn("rank", rank), queries, k, scorer)


def fast_search(vector: DataFrame | None, keyword: DataFrame | None, items: DataFrame, queries: DataFrame, k: int = 5, alpha: float = 0.5, scorer: Scorer | None = None) -> DataFrame:
    """As hybrid_search(), by weights; a missing side degrades to the other, and a hit without a text keeps ''."""
    sides = [x for x in (vector, keyword) if x is not None]
    if not sides:
        raise ValueError("both sides failed")
    empty = sides[0].limit(0)
    top = fusion.weighted(vector if vector is not None else empty, keyword if keyword is not None else empty, alpha, candidate_count(k, True))
    top = written(items.sparkSession, top, "search-hits")  # a few rows a query
    texts = items.select("id", "text").join(top.select("id").distinct(), "id", "left_semi")
    found = top.join(texts, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return reranked(found.filter(F.col("rank") <= 20), queries, k, scorer)


def search(
    sentences: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    k: int = 3,
    alpha: float = 0.5,
    method: str = "weighted",
    where: Column | None = None,
    fast: bool = False,
    paragraphs: bool = True,
    scorer: Scorer | None = None,
    cumulative: bool = False,
) -> DataFrame:
    """query_id, rank, score, id, doc_id, page_num, paragraph_id, text for queries (query_id, query), and
    with `cumulative` the context of all paragraphs up to the hit's.

    sentences: id, doc_id, page_num, paragraph_id, char_offset_start, text; vectors: id, embedding. Both
    indexes are asked, their lists fused, and each hit gets its paragraph's text (paragraphs) or its own.
    where: a condition on sentences (a document, pages), under which hits are found; it doesn't change scores.
    """
    most = candidate_count(k, fast)
    wanted = most if fast else fetch_count(k)
    keep = None if where is None else sentences.filter(where).select("id")
    keyword = bm25.search(sentences, queries, wanted, keep=keep)
    asked = embedded(queries, embedder, "query", "query_vector").select("query_id", "query_vector")
    own = vectors if keep is None else vectors.join(keep, "id", "left_semi")
    near = vector.batch_top_k(own, asked, wanted, id_col="id")
    top = fused(near, keyword, "weighted" if fast else method, alpha, most)
    top = written(sentences.sparkSession, top, "search-hits")  # at most `most` rows a query
    hits = top.join(sentences.select("id", "doc_id", "page_num", "paragraph_id", "text"), "id")
    if paragraphs:
        whole = context.paragraph_contexts(sentences.select("doc_id", "paragraph_id", "page_num", "char_offset_start", "id", "text"), hits.select(F.col("id").alias("target_id"), "doc_id", "paragraph_id").distinct())
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "char_offset_start", "id", "text"))), lambda x: x["text"]), " ")
        hits = hits.drop("text").join(whole.groupBy(F.col("target_id").alias("id")).agg(text.alias("text")), "id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    out = reranked(hits.withColumn("rank", rank).filter(F.col("rank") <= (20 if fast else most)), queries, k, scorer)
    out = out.select("query_id", "rank", "score", "id", "doc_id", "page_num", "paragraph_id", "text")
    if not cumulative:
        return out
    out = written(sentences.sparkSession, out, "search-ranked")  # k rows a query
    up = context.preceding_paragraphs(sentences, out.select("doc_id", F.col("paragraph_id").alias("target_paragraph")).distinct())
    return out.join(cumulative_context(up).select("doc_id", F.col("target_paragraph").alias("paragraph_id"), "context"), ["doc_id", "paragraph_id"], "left")


def fallback_summary(chunks: Column, kind: Column) -> Column:
    """Of an ordered array of (text, page_num): captions of tables, else both ends of the text."""
    first = F.substring(F.get(chunks, F.lit(0))["text"], 1, 200)
    last = F.when(F.size(chunks) > 1, F.substring(F.element_at(chunks, -1)["text"], 1, 200)).otherwise("")
    named = F.array_join(F.transform(chunks, lambda c: F.when(table_caption(c["text"]) != "", table_caption(c["text"])).otherwise(F.concat(F.lit("Table at page "), c["page_num"].cast("string")))), " | ")
    return F.when(F.size(chunks) == 0, "[No content]").when(kind == "table", named).otherwise(F.concat(first, F.lit("... ... "), last))


def cumulative_context(paragraphs: DataFrame) -> DataFrame:
    """From the paragraphs up to a target (target_paragraph, doc_id, paragraph_id, page_num, text, rank):
    target_paragraph, doc_id, context, summary_chunks, table_count, formula_count.

    The summary is the fallback one; a model's takes its place through chunker.batched_summaries().
    """
    by = W.partitionBy("doc_id", "target_paragraph").orderBy("rank")
    own = paragraphs.withColumn("kind", content_type(F.col("text"))).withColumn("before", F.lag("text", 1, "").over(by)).withColumn("after", F.lead("text", 1, "").over(by))
    last = F.max("rank").over(W.partitionBy("doc_id", "target_paragraph"))
    own = own.withColumn("current", F.col("rank") == last)
    item = F.struct("rank", "text", "page_num", "before", "after")
    of = lambda kind: F.sort_array(F.collect_list(F.when(~F.col("current") & (F.col("kind") == kind), item)))
    grouped = own.groupBy("doc_id", "target_paragraph").agg(
        of("text").alias("texts"), of("table").alias("tables"), of("formula").alias("formulas"), F.max(F.when(F.col("current"), F.struct("page_num", "text"))).alias("chunk")
    )
    cut = lambda x: F.substring(x, 1, 200)
    summary = F.when(F.size("texts") == 0, "").when(F.size("texts") == 1, F.get("texts", F.lit(0))["text"]).otherwise(fallback_summary(F.col("texts"), F.lit("text")))
    caption = lambda t: F.when(table_caption(t["text"]) != "", table_caption(t["text"])).otherwise(F.concat(F.lit("Table at page "), t["page_num"].cast("string")))
    tables = F.array_join(F.transform("tables", lambda t: F.concat(F.lit("\n["), caption(t), F.lit("]\n"), t["text"])), "\n")
    formula = lambda f: F.concat(
        F.when(f["before"] != "", F.concat(F.lit("Context: "), cut(f["before"]), F.lit("...\n"))).otherwise(""),
        F.lit("\nFORMULA:\n"),
        f["text"],
        F.lit("\n"),
        F.when(f["after"] != "", F.concat(F.lit("\nExplanation: "), cut(f["after"]), F.lit("..."))).otherwise(""),
    )
    formulas = F.array_join(F.transform("formulas", formula), "\n")
    # the headings are fixed values
    context = F.concat(
        F.when(F.col("summary") != "", F.concat(F.lit("=== CONTEXT SUMMARY ===\n"), "summary", F.lit("\n\n"))).otherwise(""),
        F.when(F.size("tables") > 0, F.concat(F.lit("=== TABLES (Preserved) ===\n"), tables, F.lit("\n\n"))).otherwise(""),
        F.when(F.size("formulas") > 0, F.concat(F.lit("=== FORMULAS (with Context) ===\n"), formulas, F.lit("\n\n"))).otherwise(""),
        F.concat(F.lit("=== CURRENT CHUNK (Page "), F.col("chunk.page_num").cast("string"), F.lit(") ===\n"), F.col("chunk.text")),
    )
    out = grouped.withColumn("summary", summary)
    return out.select("doc_id", "target_paragraph", context.alias("context"), *(F.size(c).cast("long").alias(n) for c, n in (("texts", "summary_chunks"), ("tables", "table_count"), ("formulas", "formula_count"))))
