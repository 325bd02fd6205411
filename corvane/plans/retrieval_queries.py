"""Dedup, BM25, vector, fusion and hybrid search queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import jaccard, word_set
from corvane.operators import bm25, context, dedup, fusion, ivf, retrieval, vector
from corvane.operators.plugins import embedded, hashing_embedder
from corvane.plans.base import CORPUS, query, terms
from corvane.plans.base import word_set as words_sql
from corvane.plans.corpus_queries import PARAGRAPHS
from corvane.plans.text_queries import caption_sql, kind_sql
from corvane.sources.corpus import paragraphs
from corvane.sources.corpus import sentences as corpus
from corvane.sources.shared import new_path, written
from corvane.sources.tables import table


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


# --- dedup


@query("dedup_exact_doc", CORPUS + "SELECT id, (length(text) < 20 OR row_number() OVER (PARTITION BY doc_id, md5(text) ORDER BY page_num, char_offset_start, id) = 1) AS first FROM sents")
def dedup_exact_doc(spark, sf_dir):
    own = corpus(table(spark, sf_dir, "documents"))
    return dedup.exact_flags(own, ["doc_id"], ["page_num", "char_offset_start", "id"]).select("id", "first")


@query("dedup_exact_corpus", "SELECT id, (length(text) < 20 OR row_number() OVER (PARTITION BY md5(text) ORDER BY id) = 1) AS first FROM (SELECT doc_id AS id, text FROM documents)")
def dedup_exact_corpus(spark, sf_dir):
    return dedup.exact_flags(_docs(spark, sf_dir), [], ["id"]).select("id", "first")


@query(
    "jaccard_pairs_docs",
    f"""WITH o AS (SELECT doc_id AS id, list_sort({words_sql('text')}) AS words FROM documents),
c AS (SELECT words, min(id) AS id FROM o WHERE len(words) > 0 GROUP BY words),
p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.words, y.words)) AS n, len(x.words) + len(y.words) AS m FROM c x JOIN c y ON x.id < y.id AND len(x.words) >= 0.8 * len(y.words) - 1e-6 AND len(y.words) >= 0.8 * len(x.words) - 1e-6)
SELECT a, b, round(n / (m - n), 6) AS similarity FROM p WHERE n / (m - n) >= 0.8 - 1e-12
UNION ALL SELECT c.id, o.id, 1.0::DOUBLE FROM o JOIN c USING (words) WHERE o.id <> c.id""",
)
def jaccard_pairs_docs(spark, sf_dir):
    """Pairs between classes of equal word sets, and the members of each class."""
    return dedup.similar_pairs(_docs(spark, sf_dir), 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _cut(spark: SparkSession):
    return lambda df: written(spark, df, "dedup")


@query("dedup_fuzzy_docs")
def dedup_fuzzy_docs(spark, sf_dir):
    """Documents that the order-dependent choice keeps, over the whole corpus."""
    docs = _docs(spark, sf_dir)
    pairs = dedup.similar_pairs(docs, 0.95)
    return dedup.greedy_kept(pairs, docs.select("id"), _cut(spark))


@query("dedup_pipeline")
def dedup_pipeline(spark, sf_dir):
    """Sentences after exact dedup in their document and fuzzy dedup in their page."""
    # dealt by document once: offsets and both stages stay within one
    own = corpus(table(spark, sf_dir, "documents").repartition("doc_id")).select("id", "doc_id", "page_num", "char_offset_start", "text")
    kept = dedup.deduplicated(own, ["doc_id"], ["doc_id", "page_num"], ["page_num", "char_offset_start", "id"], _cut(spark), fits=True)
    return kept.select("id", "doc_id", "page_num")


@query("jaccard_neighbours", f"SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS similarity FROM (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations) a JOIN (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def jaccard_neighbours(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", word_set(F.col("text")).alias("w"))
    before = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"))
    return own.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


# --- BM25

QUERY_LIST = [("q1", "the tion ing"), ("q2", "der die verheit"), ("q3", "les the les ment")]
ASKED = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUERY_LIST) + ") AS q(query_id, query)"
BM25 = f"""
p AS (SELECT id, len(t) AS length, unnest(t) AS term FROM (SELECT doc_id AS id, {terms('text')} AS t FROM documents)),
tf AS (SELECT term, id, length, count(*) AS tf FROM p GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len({terms('text')})) AS average FROM documents),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({terms('query')}) AS term FROM qs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / average))) AS score
  FROM tf JOIN asked USING (term) JOIN df USING (term), st GROUP BY ALL)
"""
HITS = "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored {where}) WHERE rank <= {k}"


def _queries(spark) -> DataFrame:
    return spark.createDataFrame(QUERY_LIST, "query_id string, query string")


@query("bm25_stats", f"SELECT count(*)::BIGINT AS n, round(avg(len({terms('text')})), 6) AS average, sum(len({terms('text')}))::BIGINT AS tokens, (SELECT count(DISTINCT t) FROM (SELECT unnest({terms('text')}) AS t FROM documents))::BIGINT AS vocabulary FROM documents")
def bm25_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    own = bm25.lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 6).alias("average"), F.sum("length").alias("tokens"))
    return own.join(bm25.postings(docs).select("term").distinct().agg(F.count(F.lit(1)).alias("vocabulary")))


@query("bm25_postings", f"SELECT term, id, length::BIGINT AS length, count(*)::BIGINT AS tf FROM (SELECT doc_id AS id, len({terms('text')}) AS length, unnest({terms('text')}) AS term FROM documents) GROUP BY ALL")
def bm25_postings(spark, sf_dir):
    return bm25.postings(_docs(spark, sf_dir))


@query("bm25_topk", f"WITH qs AS (SELECT * FROM {ASKED}), {BM25} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM ({HITS.format(where='', k=10)})")
def bm25_topk(spark, sf_dir):
    return bm25.search(_docs(spark, sf_dir), _queries(spark), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("bm25_topk_filtered", f"WITH qs AS (SELECT * FROM {ASKED}), {BM25} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM ({HITS.format(where='WHERE id IN (SELECT doc_id FROM documents WHERE source = ' + chr(39) + 'src3' + chr(39) + ')', k=5)})")
def bm25_topk_filtered(spark, sf_dir):
    keep = table(spark, sf_dir, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("id"))
    return bm25.search(_docs(spark, sf_dir), _queries(spark), 5, keep=keep).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("bm25_benchmark", f"WITH qs AS (SELECT 'b' || item_id AS query_id, text AS query FROM benchmark), {BM25} SELECT query_id, id, round(score, 5) AS score FROM ({HITS.format(where='', k=1)})")
def bm25_benchmark(spark, sf_dir):
    """The best document for every benchmark passage."""
    asked = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))
    return bm25.search(_docs(spark, sf_dir), asked, 1).select("query_id", "id", F.round("score", 5).alias("score"))


SENT_BM25 = BM25.replace("(SELECT doc_id AS id, " + terms("text") + " AS t FROM documents)", "(SELECT id, " + terms("text") + " AS t FROM sents)").replace("average FROM documents", "average FROM sents")


@query(
    "bm25_context",
    CORPUS + PARAGRAPHS + f", qs AS (SELECT * FROM {ASKED}), {SENT_BM25}, top AS ({HITS.format(where='', k=5)}) SELECT t.query_id, t.id, t.rank::INT AS rank, round(t.score, 6) AS score, s.source AS filename, g.text AS passage FROM top t JOIN sents s USING (id) JOIN g ON g.doc_id = s.doc_id AND g.paragraph_id = s.paragraph_id",
)
def bm25_context(spark, sf_dir):
    """The five best sentences of each query, each with its whole paragraph and file name. A hit's id
    names its document, so only the documents of hits are split again."""
    docs = table(spark, sf_dir, "documents")
    top = written(spark, bm25.search(corpus(docs), _queries(spark), 5), "hits")
    wanted = top.select(F.substring_index("id", "_", 1).cast("long").alias("doc_id")).distinct()
    sents = corpus(docs.join(wanted, "doc_id", "left_semi"))
    hits = sents.join(top, "id").select("query_id", "id", "rank", "score", F.col("source").alias("filename"), "doc_id", "paragraph_id")
    whole = context.paragraph_contexts(sents.select("doc_id", "paragraph_id", "page_num", "char_offset_start", "id", "text"), hits.select(F.col("id").alias("target_id"), "doc_id", "paragraph_id").distinct())
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", "char_offset_start", "id", "text"))), lambda x: x["text"]), " ")
    passages = whole.groupBy("target_id").agg(text.alias("passage"))
    return hits.join(passages, hits["id"] == passages["target_id"]).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "filename", "passage")


# --- vectors

COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vector0(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]  # the query, one row


@query("cosine_topk", f"SELECT v.vec_id AS id, round({COS}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round({COS}, 9) DESC, 1 LIMIT 20")
def cosine_topk(spark, sf_dir):
    return vector.top_k(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 20).select("id", F.round("score", 6).alias("score"))


@query("cosine_topk_filtered", f"SELECT v.vec_id AS id, round({COS}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label = 3 ORDER BY round({COS}, 9) DESC, 1 LIMIT 5")
def cosine_topk_filtered(spark, sf_dir):
    return vector.top_k(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 5, F.col("label") == 3).select("id", F.round("score", 6).alias("score"))


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("cosine_batch_topk", f"SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 5")
def cosine_batch_topk(spark, sf_dir):
    """Every query (ids divisible by 20) against all rows."""
    return vector.batch_top_k(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("mean_vector", "SELECT label, pos::INT AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def mean_vector(spark, sf_dir):
    return vector.mean_vectors(table(spark, sf_dir, "embeddings"), "label").select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@query(
    "ivf_topk",
    f"""WITH m AS (SELECT label, list(x ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS at FROM (SELECT e.vec_id, e.embedding, m.label, list_cosine_similarity(e.embedding::DOUBLE[], m.centre) AS c FROM embeddings e, m WHERE e.vec_id % 20 = 0))
SELECT query_id, id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, v.vec_id) AS rank FROM embeddings v JOIN n q ON v.label = q.label AND q.at <= 4 AND q.vec_id <> v.vec_id) WHERE rank <= 5""",
)
def ivf_topk(spark, sf_dir):
    """The same queries, looking into the four cells with the nearest centres."""
    own = table(spark, sf_dir, "embeddings")
    return vector.ivf_top_k(own, _asked(spark, sf_dir), vector.centroids(own, "label"), "label", 4, 5).select("query_id", "id", F.round("score", 6).alias("score"))


@query("embed_texts")
def embed_texts(spark, sf_dir):
    """Texts embedded once for each distinct text, by the deterministic plug-in."""
    out = embedded(_docs(spark, sf_dir), hashing_embedder(16))
    return out.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


# --- fusion: vec_id = doc_id is a test convention

LISTS = f"""WITH qs AS (SELECT 'q1' AS query_id, 'the tion ing' AS query), {BM25},
b AS ({HITS.format(where='', k=20)}),
v AS (SELECT 'q1' AS query_id, vec_id AS id, score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (SELECT v.vec_id, {COS} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 20),
j AS (SELECT 'q1' AS query_id, coalesce(v.id, b.id) AS id, v.score AS vs, b.score AS bs, v.rank AS vr, b.rank AS br FROM v FULL OUTER JOIN b ON v.id = b.id)
"""
WEIGHTED = """, w AS (SELECT query_id, id, 0.5 * CASE WHEN max(vs) OVER () > 0 THEN coalesce(vs, 0) / max(vs) OVER () ELSE 0 END + 0.5 * CASE WHEN max(bs) OVER () > 0 THEN coalesce(bs, 0) / max(bs) OVER () ELSE 0 END AS score, vr, br FROM j),
f AS (SELECT query_id, id, score, row_number() OVER (ORDER BY round(score, 9) DESC, vr NULLS LAST, br NULLS LAST, id) AS rank FROM w)
"""


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window as W

    asked = spark.createDataFrame(QUERY_LIST[:1], "query_id string, query string")
    keyword = bm25.search(_docs(spark, sf_dir), asked, 20)
    near = vector.top_k(table(spark, sf_dir, "embeddings"), _vector0(spark, sf_dir), 20)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return near.withColumn("query_id", F.lit("q1")).withColumn("rank", rank), keyword


@query("fusion_weighted", LISTS + WEIGHTED + "SELECT id, round(score, 6) AS score, rank::INT AS rank FROM f")
def fusion_weighted(spark, sf_dir):
    return fusion.weighted(*_lists(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "rank")


@query("fusion_rrf", LISTS + "SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, vr NULLS LAST, br NULLS LAST, id)::INT AS rank FROM (SELECT id, vr, br, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0) AS score FROM j)")
def fusion_rrf(spark, sf_dir):
    return fusion.reciprocal_rank(*_lists(spark, sf_dir)).select("id", F.round("score", 6).alias("score"), "rank")


@query("fusion_one_side", LISTS + "SELECT id, round(0.5 * score / max(score) OVER (), 6) AS score, rank::INT AS rank FROM b")
def fusion_one_side(spark, sf_dir):
    """A vector leg without hits."""
    near, keyword = _lists(spark, sf_dir)
    return fusion.weighted(near.limit(0), keyword).select("id", F.round("score", 6).alias("score"), "rank")


@query("hybrid_search", LISTS + WEIGHTED + "SELECT id, rank::INT AS rank, round(score, 6) AS score, md5(text) AS digest FROM (SELECT f.id, f.score, d.text, row_number() OVER (ORDER BY f.rank) AS rank FROM f JOIN documents d ON d.doc_id = f.id WHERE f.rank <= 10) WHERE rank <= 5")
def hybrid_search(spark, sf_dir):
    near, keyword = _lists(spark, sf_dir)
    out = retrieval.hybrid_search(near, keyword, _docs(spark, sf_dir), _queries(spark), 5)
    return out.select("id", "rank", F.round("score", 6).alias("score"), F.md5("text").alias("digest"))


@query("fast_search", LISTS + WEIGHTED + "SELECT f.id, f.rank::INT AS rank, round(f.score, 6) AS score, md5(coalesce(d.text, '')) AS digest FROM f LEFT JOIN documents d ON d.doc_id = f.id WHERE f.rank <= 5")
def fast_search(spark, sf_dir):
    near, keyword = _lists(spark, sf_dir)
    out = retrieval.fast_search(near, keyword, _docs(spark, sf_dir), _queries(spark), 5)
    return out.select("id", "rank", F.round("score", 6).alias("score"), F.md5("text").alias("digest"))


CUMULATIVE = f"""
, l AS (SELECT *, {kind_sql('para')} AS kind, {caption_sql('para')} AS caption, lag(para, 1, '') OVER w AS before, lead(para, 1, '') OVER w AS after, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1 AS last FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
a AS (SELECT doc_id, count(*) FILTER (NOT last AND kind = 'text') AS nt, count(*) FILTER (NOT last AND kind = 'table') AS nb, count(*) FILTER (NOT last AND kind = 'formula') AS nf,
  arg_min(para, pos) FILTER (NOT last AND kind = 'text') AS t1, arg_max(para, pos) FILTER (NOT last AND kind = 'text') AS t2,
  string_agg(chr(10) || '[' || CASE WHEN caption <> '' THEN caption ELSE 'Table at page ' || page_num END || ']' || chr(10) || para, chr(10) ORDER BY pos) FILTER (NOT last AND kind = 'table') AS tables,
  string_agg(CASE WHEN before <> '' THEN 'Context: ' || left(before, 200) || '...' || chr(10) ELSE '' END || chr(10) || 'FORMULA:' || chr(10) || para || chr(10) || CASE WHEN after <> '' THEN chr(10) || 'Explanation: ' || left(after, 200) || '...' ELSE '' END, chr(10) ORDER BY pos) FILTER (NOT last AND kind = 'formula') AS formulas,
  max(page_num) FILTER (last) AS page, max(para) FILTER (last) AS para FROM l GROUP BY 1)
SELECT doc_id, nt::BIGINT AS summary_chunks, nb::BIGINT AS table_count, nf::BIGINT AS formula_count, md5(
  CASE WHEN nt = 0 THEN '' ELSE '=== CONTEXT SUMMARY ===' || chr(10) || CASE WHEN nt = 1 THEN t1 ELSE left(t1, 200) || '... ... ' || left(t2, 200) END || chr(10) || chr(10) END ||
  CASE WHEN nb > 0 THEN '=== TABLES (Preserved) ===' || chr(10) || tables || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN nf > 0 THEN '=== FORMULAS (with Context) ===' || chr(10) || formulas || chr(10) || chr(10) ELSE '' END ||
  '=== CURRENT CHUNK (Page ' || page || ') ===' || chr(10) || para) AS digest FROM a
"""


@query("cumulative_context", CORPUS + CUMULATIVE)
def cumulative_context(spark, sf_dir):
    """The context of every document's last paragraph."""
    own = paragraphs(table(spark, sf_dir, "documents"))
    from pyspark.sql.window import Window as W

    up = own.select("doc_id", F.lit("last").alias("target_paragraph"), "paragraph_id", "page_num", F.col("para").alias("text"), F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).alias("rank"))
    return retrieval.cumulative_context(up).select("doc_id", "summary_chunks", "table_count", "formula_count", F.md5("context").alias("digest"))


FILTERED = CORPUS + PARAGRAPHS + f""", qs AS (SELECT 'q1' AS query_id, 'the tion ing' AS query), {SENT_BM25},
keep AS (SELECT id FROM sents WHERE doc_id % 7 = 3 AND page_num BETWEEN 1 AND 2),
b AS ({HITS.format(where='WHERE id IN (SELECT id FROM keep)', k=20)}),
f AS (SELECT query_id, id, 0.5 * score / max(score) OVER () AS score, rank FROM b)
SELECT f.id, f.rank::INT AS rank, round(f.score, 6) AS score, s.doc_id, md5(g.text) AS digest FROM f JOIN sents s USING (id) JOIN g ON g.doc_id = s.doc_id AND g.paragraph_id = s.paragraph_id WHERE f.rank <= 5"""


@query("search_filtered", FILTERED)
def search_filtered(spark, sf_dir):
    """Search within some documents' first pages: whole paragraphs; the vector index is still empty."""
    sents = corpus(table(spark, sf_dir, "documents"))
    none = spark.createDataFrame([], "id string, embedding array<float>")
    out = retrieval.search(sents, none, spark.createDataFrame(QUERY_LIST[:1], "query_id string, query string"), hashing_embedder(16), 5, where=F.expr("doc_id % 7 = 3 and page_num between 1 and 2"))
    return out.select("id", "rank", F.round("score", 6).alias("score"), "doc_id", F.md5("text").alias("digest"))


#: A sentence's vector, by convention of the test tables: a row of embeddings that its place and length name.
VECTOR_OF = "(doc_id * 31 + char_offset_start * 7 + length(text)) % (SELECT count(*) FROM embeddings)"
UP_TO = f"""
, m AS (SELECT h.id, h.rank AS hit_rank, h.score, h.doc_id, h.digest, p.page_num, p.text AS para, p.rank AS pos, row_number() OVER (PARTITION BY h.id ORDER BY p.rank DESC) = 1 AS last
  FROM hits h JOIN ranked t ON t.doc_id = h.doc_id AND t.paragraph_id = h.paragraph_id JOIN ranked p ON p.doc_id = h.doc_id AND p.rank <= t.rank),
l AS (SELECT *, {kind_sql('para')} AS kind, {caption_sql('para')} AS caption, lag(para, 1, '') OVER w AS before, lead(para, 1, '') OVER w AS after FROM m WINDOW w AS (PARTITION BY id ORDER BY pos)),
a AS (SELECT id, any_value(hit_rank) AS hit_rank, any_value(score) AS score, any_value(doc_id) AS doc_id, any_value(digest) AS digest, count(*) FILTER (NOT last AND kind = 'text') AS nt,
  arg_min(para, pos) FILTER (NOT last AND kind = 'text') AS t1, arg_max(para, pos) FILTER (NOT last AND kind = 'text') AS t2,
  string_agg(chr(10) || '[' || CASE WHEN caption <> '' THEN caption ELSE 'Table at page ' || page_num END || ']' || chr(10) || para, chr(10) ORDER BY pos) FILTER (NOT last AND kind = 'table') AS tables,
  string_agg(CASE WHEN before <> '' THEN 'Context: ' || left(before, 200) || '...' || chr(10) ELSE '' END || chr(10) || 'FORMULA:' || chr(10) || para || chr(10) || CASE WHEN after <> '' THEN chr(10) || 'Explanation: ' || left(after, 200) || '...' ELSE '' END, chr(10) ORDER BY pos) FILTER (NOT last AND kind = 'formula') AS formulas,
  max(page_num) FILTER (last) AS page, max(para) FILTER (last) AS para FROM l GROUP BY 1)
SELECT id, hit_rank::INT AS rank, round(score, 6) AS score, doc_id, digest, md5(
  CASE WHEN nt = 0 THEN '' ELSE '=== CONTEXT SUMMARY ===' || chr(10) || CASE WHEN nt = 1 THEN t1 ELSE left(t1, 200) || '... ... ' || left(t2, 200) END || chr(10) || chr(10) END ||
  CASE WHEN tables IS NOT NULL THEN '=== TABLES (Preserved) ===' || chr(10) || tables || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN formulas IS NOT NULL THEN '=== FORMULAS (with Context) ===' || chr(10) || formulas || chr(10) || chr(10) ELSE '' END ||
  '=== CURRENT CHUNK (Page ' || page || ') ===' || chr(10) || para) AS context FROM a
"""
HYBRID = (
    CORPUS
    + PARAGRAPHS
    + f""", qs AS (SELECT 'q1' AS query_id, 'the tion ing' AS query), {SENT_BM25},
keep AS (SELECT id FROM sents WHERE doc_id % 3 = 1 AND page_num BETWEEN 1 AND 3),
b AS ({HITS.format(where='WHERE id IN (SELECT id FROM keep)', k=20)}),
v AS (SELECT 'q1' AS query_id, id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM
  (SELECT s.id, {COS} AS score FROM (SELECT id, {VECTOR_OF} AS vec_id FROM sents WHERE id IN (SELECT id FROM keep)) s JOIN embeddings v USING (vec_id), (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 20),
j AS (SELECT 'q1' AS query_id, coalesce(v.id, b.id) AS id, v.score AS vs, b.score AS bs, v.rank AS vr, b.rank AS br FROM v FULL OUTER JOIN b ON v.id = b.id)
"""
    + WEIGHTED
    + """, hits AS (SELECT f.id, f.rank, f.score, s.doc_id, s.paragraph_id, md5(g.text) AS digest FROM f JOIN sents s USING (id) JOIN g ON g.doc_id = s.doc_id AND g.paragraph_id = s.paragraph_id WHERE f.rank <= 5)
"""
    + UP_TO
)


@query("search_hybrid", HYBRID)
def search_hybrid(spark, sf_dir):
    """End to end: sentence vectors and postings under a filter, fused, whole paragraphs, and the context up to each."""
    sents, known = corpus(table(spark, sf_dir, "documents")), table(spark, sf_dir, "embeddings")
    place = F.pmod(F.col("doc_id") * 31 + F.col("char_offset_start") * 7 + F.length("text"), F.lit(known.count()))
    vectors = sents.select("id", place.alias("vec_id")).join(known.select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    asked = np.array(_vector0(spark, sf_dir))
    out = retrieval.search(sents, vectors, spark.createDataFrame(QUERY_LIST[:1], "query_id string, query string"), lambda texts: np.tile(asked, (len(texts), 1)), 5, where=F.expr("doc_id % 3 = 1 and page_num between 1 and 3"), cumulative=True)
    return out.select("id", "rank", F.round("score", 6).alias("score"), "doc_id", F.md5("text").alias("digest"), F.md5("context").alias("context"))


# --- trained cells

START = 12


@query(
    "ivf_cells",
    f"""WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
c0 AS (SELECT vec_id::INT AS cell, v AS c FROM u WHERE vec_id < {START}),
a0 AS (SELECT vec_id, v, arg_max(cell, list_dot_product(v, c)) AS cell FROM u, c0 GROUP BY ALL),
s0 AS (SELECT cell, k, sum(x) AS x FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a0) GROUP BY ALL),
c1 AS (SELECT cell, list(x ORDER BY k) AS c FROM s0 GROUP BY 1),
n1 AS (SELECT cell, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c1),
a1 AS (SELECT vec_id, v, arg_max(cell, list_dot_product(v, c)) AS cell FROM u, n1 GROUP BY ALL)
SELECT cell, count(*)::BIGINT AS vectors, sum(vec_id)::BIGINT AS ids FROM a1 GROUP BY 1""",
)
def ivf_cells(spark, sf_dir):
    """Cells after one round of training from given centres."""
    own = table(spark, sf_dir, "embeddings")
    start = np.array([r[0] for r in own.filter(F.col("vec_id") < START).orderBy("vec_id").select("embedding").collect()], np.float64)
    centres = ivf.trained(own, len(start), 1, start)
    return ivf.assigned(ivf.usable(own), centres).groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"), F.sum("id").alias("ids"))


@query("ivf_search")
def ivf_search(spark, sf_dir):
    """Trained cells, vectors stored by cell, and every twentieth vector's nearest in a few cells."""
    own, path = table(spark, sf_dir, "embeddings"), new_path(spark, "ivf")
    ivf.stored(own, ivf.trained(own, 16), path)
    asked = own.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return ivf.probed(spark, path, asked, 8).select("query_id", "id", "rank", F.round("score", 6).alias("score"))
