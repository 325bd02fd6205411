"""Corpus, store and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.text import sentences as split_sentences
from corvane.operators import context, store
from corvane.plans.base import CORPUS, query, sentences
from corvane.sources.corpus import paragraphs
from corvane.sources.corpus import sentences as corpus
from corvane.sources.tables import table


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(table(spark, sf_dir, "documents"))


@query("sentence_split", f"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", split_sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query("corpus_sentences", CORPUS + "SELECT id, doc_id, page_num, paragraph_id, sentence_id, text, char_offset_start, (char_offset_start + length(text))::INT AS char_offset_end, 'paragraph' AS item_type FROM sents")
def corpus_sentences(spark, sf_dir):
    return _sents(spark, sf_dir).drop("source")


@query("sentence_lookup", CORPUS + "SELECT s.id, s.text, s.page_num, d.source AS filename FROM sents s JOIN documents d USING (doc_id) WHERE s.id = '7_p1_para1_s1'")
def sentence_lookup(spark, sf_dir):
    found = _sents(spark, sf_dir).filter("doc_id = 7 and id = '7_p1_para1_s1'").drop("source")
    return found.join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename")), "doc_id").select("id", "text", "page_num", "filename")


@query("sentences_by_doc", CORPUS + "SELECT id, page_num, char_offset_start, row_number() OVER (ORDER BY page_num, char_offset_start, id)::BIGINT AS rn FROM sents WHERE doc_id = 7")
def sentences_by_doc(spark, sf_dir):
    own = _sents(spark, sf_dir).filter("doc_id = 7")
    return own.withColumn("rn", F.row_number().over(context.in_document()).cast("long")).select("id", "page_num", "char_offset_start", "rn")


@query("sentences_by_ids_join", CORPUS + "SELECT s.id, s.doc_id, d.lang, length(s.text)::BIGINT AS chars FROM sents s JOIN documents d USING (doc_id) WHERE s.sentence_id = 'p1_para1_s1'")
def sentences_by_ids_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("_p1_para1_s1")).alias("id"))
    found = _sents(spark, sf_dir).join(wanted, "id", "left_semi")
    return found.join(docs.select("doc_id", "lang"), "doc_id").select("id", "doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("page_exists", CORPUS + "SELECT doc_id, page_num, (page_num <= 2) AS present FROM paras GROUP BY 1, 2")
def page_exists(spark, sf_dir):
    """Every page, and whether a store that holds the first two pages of each document has it."""
    pages = paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "page_num").distinct()
    stored = pages.filter("page_num <= 2")
    here = store.pages_present(pages, stored).withColumn("present", F.lit(True))
    return here.unionByName(store.pages_to_ingest(pages, stored).withColumn("present", F.lit(False)))


@query("pages_to_ingest", CORPUS + "SELECT doc_id, page_num FROM paras GROUP BY 1, 2 HAVING page_num > 2")
def pages_to_ingest(spark, sf_dir):
    pages = paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "page_num").distinct()
    return store.pages_to_ingest(pages, pages.filter("page_num <= 2"))


DOCS_SQL = "WITH d AS (SELECT doc_id, source AS filename, 0 AS total_pages, CASE WHEN lang = 'en' THEN 'completed' WHEN lang = 'fr' THEN NULL ELSE 'failed' END AS status, TIMESTAMP '2024-01-01' + to_seconds(n_chars % 5000) AS created_at FROM documents)"


def _docs(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("lang") == "en", "completed").when(F.col("lang") == "fr", F.lit(None)).otherwise("failed")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") % 5000)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), F.lit(0).alias("total_pages"), status.alias("status"), F.lit(None).cast("string").alias("doc_metadata"), at.alias("created_at"))


@query("doc_list", DOCS_SQL + "SELECT doc_id, filename, coalesce(status, 'processing') AS status, row_number() OVER (ORDER BY created_at DESC, doc_id)::BIGINT AS pos FROM d")
def doc_list(spark, sf_dir):
    """The whole list, newest first; the place of each row shows the order."""
    return store.numbered(spark, store.listed(store.defaults(_docs(spark, sf_dir))).select("doc_id", "filename", "status"), "pos")


@query("doc_lookup", DOCS_SQL + "SELECT doc_id, filename, coalesce(status, 'processing') AS status, '{}' AS doc_metadata FROM d WHERE doc_id = 7")
def doc_lookup(spark, sf_dir):
    return store.lookup(_docs(spark, sf_dir), 7).select("doc_id", "filename", "status", "doc_metadata")


@query("doc_status", DOCS_SQL + ", l AS (SELECT user_id AS doc_id, event_type, ts FROM events) SELECT d.doc_id, coalesce(x.s, d.status) AS status FROM d LEFT JOIN (SELECT doc_id, arg_max(event_type, ts) AS s FROM l GROUP BY 1) x USING (doc_id)")
def doc_status(spark, sf_dir):
    """Statuses after a log of updates, the latest of each document winning."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), "ts")
    return store.with_status(_docs(spark, sf_dir), log).select("doc_id", "status")


@query("delete_cascade", CORPUS + "SELECT doc_id, count(*)::BIGINT AS n FROM sents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def delete_cascade(spark, sf_dir):
    """Sentences left of each document after the documents labelled toxic are deleted."""
    gone = table(spark, sf_dir, "labels").filter("toxic = 1")
    return store.without(_sents(spark, sf_dir), gone).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("store_stats", CORPUS + "SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(*) FROM sents)::BIGINT AS sentences, (SELECT count(*) FROM conversations)::BIGINT AS chat_messages")
def store_stats(spark, sf_dir):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(table(spark, sf_dir, "documents"), "documents").join(count(_sents(spark, sf_dir), "sentences")).join(count(table(spark, sf_dir, "conversations"), "chat_messages"))


@query(
    "context_window",
    CORPUS
    + """SELECT id, count(*) OVER w::BIGINT AS n, md5(string_agg(text, ' ') OVER w) AS digest FROM sents
WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, char_offset_start, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
)
def context_window(spark, sf_dir):
    """The text around every sentence, two places each way."""
    return context.all_windows(_sents(spark, sf_dir), 2).select("id", F.col("n").cast("long").alias("n"), F.md5("context").alias("digest"))


@query("context_window_target", CORPUS + ", r AS (SELECT *, row_number() OVER (ORDER BY page_num, char_offset_start, id) AS rn FROM sents WHERE doc_id = 7), t AS (SELECT rn FROM r WHERE id = '7_p1_para1_s2') SELECT r.id, r.text FROM r, t WHERE r.rn BETWEEN t.rn - 2 AND t.rn + 2")
def context_window_target(spark, sf_dir):
    """The window of one sentence: a point lookup."""
    target = spark.range(1).select(F.lit("7_p1_para1_s2").alias("target_id"), F.lit(7).cast("long").alias("doc_id"))
    return context.context_windows(_sents(spark, sf_dir).filter("doc_id = 7"), target).select("id", "text")


PARAGRAPHS = """, g AS (SELECT doc_id, paragraph_id, min(page_num) AS page_num, min(char_offset_start) AS start, count(*) AS n, string_agg(text, ' ' ORDER BY page_num, char_offset_start, id) AS text FROM sents GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, start, paragraph_id) AS rank FROM g)
"""


@query("paragraph_context", CORPUS + PARAGRAPHS + "SELECT doc_id, paragraph_id, page_num, text, rank::BIGINT AS rank FROM ranked")
def paragraph_context(spark, sf_dir):
    return context.assembled_paragraphs(_sents(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("paragraph_context_batch", CORPUS + PARAGRAPHS + "SELECT s.id AS target_id, g.n::BIGINT AS siblings, md5(g.text) AS digest FROM sents s JOIN g USING (doc_id, paragraph_id)")
def paragraph_context_batch(spark, sf_dir):
    """Its paragraph for every sentence: assembled once a paragraph, which knows its sentences."""
    paras = context.paragraphs_of_sentences(_sents(spark, sf_dir), ("doc_id", "page_num", "paragraph_id"))
    found = paras.select(F.md5("text").alias("digest"), "ids").select("digest", F.size("ids").cast("long").alias("siblings"), F.explode("ids").alias("target_id"))
    return found.select("target_id", "siblings", "digest")


@query("preceding_paragraphs", CORPUS + PARAGRAPHS + "SELECT doc_id, paragraph_id, rank::BIGINT AS rank, count(*) OVER w::BIGINT AS n, sum(length(text)) OVER w::BIGINT AS chars FROM ranked WINDOW w AS (PARTITION BY doc_id ORDER BY rank)")
def preceding_paragraphs(spark, sf_dir):
    """How many paragraphs, and characters, stand up to each paragraph (a prefix frame, not pairs)."""
    paras = context.assembled_paragraphs(_sents(spark, sf_dir))
    up = W.partitionBy("doc_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return paras.select("doc_id", "paragraph_id", F.col("rank").cast("long").alias("rank"), F.count(F.lit(1)).over(up).alias("n"), F.sum(F.length("text").cast("long")).over(up).alias("chars"))


@query("results_by_document", CORPUS + "SELECT doc_id, string_agg(paragraph_id, ',' ORDER BY pos) AS paragraphs FROM paras GROUP BY 1")
def results_by_document(spark, sf_dir):
    """Group to list, in reading order."""
    own = paragraphs(table(spark, sf_dir, "documents"))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "paragraph_id"))), lambda x: x["paragraph_id"]), ",").alias("paragraphs"))
