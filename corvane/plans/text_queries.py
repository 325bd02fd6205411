"""Text-processing queries. Where the tables hold no case of an operator, one is written into the text
from its columns, alike in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions import text as T
from corvane.operators import retrieval
from corvane.plans.base import CORPUS, query, quoted, trim
from corvane.sources.corpus import paragraphs
from corvane.sources.corpus import sentences as corpus
from corvane.sources.tables import table


@query("token_estimate", r"SELECT doc_id, ceil(len(regexp_split_to_array(text, '\s+')) * 1.3::DOUBLE)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def _meta(x: str) -> str:
    tests = [f"regexp_matches({trim(x)}, {quoted(p if cased else '(?i)' + p)})" for p, cased in T.METADATA_PATTERNS]
    tests += [f"contains(lower({trim(x)}), {quoted(p)})" for p in T.BOILERPLATE_PHRASES]
    return f"({trim(x)} <> '' AND ({' OR '.join(tests)}))"


NOISE = "text || chr(10) || 'Page ' || doc_id || ' of 9' || chr(10) || '10.0.0.' || (doc_id % 256) || ' visited' || chr(10) || 'https://example.org/' || doc_id || chr(10) || 'Doi: 10/' || doc_id || chr(10) || 'Terms & Conditions'"


def _noisy():
    i = F.col("doc_id").cast("string")
    return F.concat("text", F.lit("\nPage "), i, F.lit(" of 9\n10.0.0."), (F.col("doc_id") % 256).cast("string"), F.lit(" visited\nhttps://example.org/"), i, F.lit("\nDoi: 10/"), i, F.lit("\nTerms & Conditions"))


@query("metadata_filter", f"SELECT doc_id, length({trim('kept')})::BIGINT AS chars, md5({trim('kept')}) AS digest FROM (SELECT doc_id, array_to_string(list_filter(string_split({NOISE}, chr(10)), lambda x: NOT {_meta('x')}), chr(10)) AS kept FROM documents)")
def metadata_filter(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", T.without_metadata(_noisy()).alias("kept"))
    return own.select("doc_id", F.length("kept").cast("long").alias("chars"), F.md5("kept").alias("digest"))


@query("boilerplate_lines", CORPUS.rstrip() + f", noisy AS (SELECT doc_id, unnest(string_split({NOISE}, chr(10))) AS line FROM documents) SELECT doc_id, line FROM noisy WHERE {_meta('line')}")
def boilerplate_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(_noisy(), "\n")).alias("line"))
    return lines.filter(T.is_metadata_line(F.col("line")))


@query("short_rows", CORPUS + f"SELECT id FROM sents WHERE length({trim('text')}) < 10")
def short_rows(spark, sf_dir):
    """Sentences that the row filter drops."""
    return corpus(table(spark, sf_dir, "documents")).filter(F.length(T.trimmed(F.col("text"))) < 10).select("id")


CITED = "text || ' see Table ' || (doc_id % 9) || '. [' || (doc_id % 7) || ', 2] and Fig. ' || (doc_id % 5) || '.' || (doc_id % 3)"


@query(
    "cross_references",
    f"WITH d AS (SELECT doc_id, {CITED} AS t FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id AS source_id, {quoted(kind)} AS ref_type, unnest(regexp_extract_all(t, {quoted(p)})) AS ref_text FROM d" for kind, p in T.REFERENCE_PATTERNS),
)
def cross_references(spark, sf_dir):
    """The edge list, one row a reference."""
    n = lambda k: (F.col("doc_id") % k).cast("string")
    cited = F.concat("text", F.lit(" see Table "), n(9), F.lit(". ["), n(7), F.lit(", 2] and Fig. "), n(5), F.lit("."), n(3))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.explode(T.references(cited)).alias("r")).select("source_id", "r.ref_type", "r.ref_text")


def _count(x: str, of: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(of)}))"


def kind_sql(x: str) -> str:
    latex = " OR ".join(f"contains({x}, {quoted(m)})" for m in T.LATEX_MARKERS)
    maths = " + ".join(f"contains({x}, {quoted(k)})::INT" for k in T.MATH_KEYWORDS)
    return f"CASE WHEN {_count(x, chr(92) + '|')} > 2 OR regexp_matches({trim(x)}, '(?i)^Table\\b') THEN 'table' WHEN {latex} OR ({maths}) >= 2 THEN 'formula' ELSE 'text' END"


@query("content_type", CORPUS + f"SELECT doc_id, paragraph_id, {kind_sql('para')} AS kind FROM paras")
def content_type(spark, sf_dir):
    return paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "paragraph_id", T.content_type(F.col("para")).alias("kind"))


def caption_sql(x: str) -> str:
    match = trim(rf"regexp_extract({x}, '(?i)Table\s+\d+\.?\d*\s*:\s*[^\n|]+')")
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {trim('l')}), lambda l: l <> '' AND NOT contains(l, '|'))"
    return f"CASE WHEN {match} <> '' THEN {match} ELSE coalesce({lines}[1], '') END"


TABLED = "CASE WHEN doc_id % 2 = 0 THEN '|a|b|' || chr(10) || 'Table ' || doc_id || '.1: Values of ' || source || '|x' || chr(10) || text ELSE '|a|b|' || chr(10) || text END"


@query("table_caption", f"SELECT doc_id, {caption_sql('t')} AS caption FROM (SELECT doc_id, {TABLED} AS t FROM documents)")
def table_caption(spark, sf_dir):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("|a|b|\nTable "), F.col("doc_id").cast("string"), F.lit(".1: Values of "), "source", F.lit("|x\n"), "text")).otherwise(F.concat(F.lit("|a|b|\n"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.table_caption(head).alias("caption"))


FIGURES = " OR ".join(f"regexp_matches({trim('x')}, {quoted('(?i)' + p)})" for p in T.FIGURE_PATTERNS)
WORDS = " OR ".join(f"contains(lower({trim('x')}), {quoted(w)})" for w in T.CAPTION_WORDS)
SYMBOLS = r"[\\=+\-_^{}\[\]$]"


@query("figure_caption", f"SELECT doc_id, ({FIGURES} OR (length(x) > 0 AND {_count('x', SYMBOLS)} / length(x) < 0.05 AND regexp_matches({trim('x')}, '^[A-Z]') AND ({WORDS}))) AS caption FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Fig.' || doc_id || ' ' || source WHEN 1 THEN 'Curve shows ' || source WHEN 2 THEN 'x_{{1}} = shows y^2' ELSE lang || ' shows it' END AS x FROM documents)".replace("{{", "{").replace("}}", "}"))
def figure_caption(spark, sf_dir):
    k = F.col("doc_id") % 4
    x = F.when(k == 0, F.concat(F.lit("Fig."), F.col("doc_id").cast("string"), F.lit(" "), "source")).when(k == 1, F.concat(F.lit("Curve shows "), "source")).when(k == 2, "x_{1} = shows y^2").otherwise(F.concat("lang", F.lit(" shows it")))
    return table(spark, sf_dir, "documents").select("doc_id", T.is_figure_caption(x).alias("caption"))


@query(
    "fallback_summary",
    CORPUS
    + """SELECT doc_id, left(arg_min(para, pos), 200) || '... ... ' || CASE WHEN count(*) > 1 THEN left(arg_max(para, pos), 200) ELSE '' END AS summary FROM paras GROUP BY 1""",
)
def fallback_summary(spark, sf_dir):
    own = paragraphs(table(spark, sf_dir, "documents"))
    chunks = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("para").alias("text"), "page_num"))), lambda x: F.struct(x["text"].alias("text"), x["page_num"].alias("page_num")))
    return own.groupBy("doc_id").agg(chunks.alias("chunks")).select("doc_id", retrieval.fallback_summary(F.col("chunks"), F.lit("text")).alias("summary"))


@query("page_summary_inputs", CORPUS + "SELECT doc_id, page_num, count(*)::BIGINT AS item_count, md5(string_agg(text, chr(10) || chr(10) ORDER BY char_offset_start, id)) AS digest FROM sents GROUP BY 1, 2 HAVING length(string_agg(text, chr(10) || chr(10) ORDER BY char_offset_start, id)) >= 50")
def page_summary_inputs(spark, sf_dir):
    own = corpus(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("char_offset_start", "id", "text"))), lambda x: x["text"]), "\n\n")
    return own.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("item_count"), text.alias("text")).filter(F.length("text") >= 50).select("doc_id", "page_num", "item_count", F.md5("text").alias("digest"))


TAGGED = """text || ' <tool_call>{"name":"search","arguments":{"turn":' || turn || '}}</tool_call> and <tool_call>{bad</tool_call>'"""


@query(
    "tool_call_extract",
    f"""WITH c AS (SELECT conv_id, turn, {TAGGED} AS t FROM conversations),
b AS (SELECT conv_id, turn, t, unnest(regexp_extract_all(t, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1)) AS body FROM c)
SELECT conv_id, turn, body->>'$.name' AS name, body->'$.arguments'->>'$.turn' AS argument, {trim("regexp_replace(t, '(?s)<tool_call>\\s*.*?\\s*</tool_call>', '', 'g')")} AS text FROM b WHERE json_valid(body) AND body->>'$.name' <> ''""",
)
def tool_call_extract(spark, sf_dir):
    tagged = F.concat("text", F.lit(' <tool_call>{"name":"search","arguments":{"turn":'), F.col("turn").cast("string"), F.lit("}}</tool_call> and <tool_call>{bad</tool_call>"))
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", tagged.alias("t"))
    return own.select("conv_id", "turn", F.explode(T.tool_calls(F.col("t"))).alias("c"), T.without_tool_calls(F.col("t")).alias("text")).select("conv_id", "turn", "c.name", F.get_json_object("c.arguments", "$.turn").alias("argument"), "text")


@query("core_fact_detect", "SELECT conv_id, turn, 'User mentioned: ' || t AS content FROM (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'My name is ' || conv_id || '. ' || text ELSE text END AS t FROM conversations) WHERE role = 'user' AND (" + " OR ".join(f"contains(lower(t), {quoted(p)})" for p in T.CORE_PHRASES) + ")")
def core_fact_detect(spark, sf_dir):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("My name is "), F.col("conv_id").cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))
    own = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", said.alias("t"))
    return own.filter(T.is_core_fact(F.col("t"))).select("conv_id", "turn", F.concat(F.lit("User mentioned: "), "t").alias("content"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 20000 THEN length(text) ELSE 20000 + length(chr(10) || chr(10) || '[... truncated at 20000 chars]') END::BIGINT AS chars FROM documents")
def truncate_text(spark, sf_dir):
    """The workspace-file cut, whose bound is the feature."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.truncated(F.col("text"))).cast("long").alias("chars"))


@query("formula_context", CORPUS + f"SELECT doc_id, paragraph_id, md5(before) AS before, md5(after) AS after FROM (SELECT doc_id, paragraph_id, {kind_sql('para')} AS kind, lag(para, 1, '') OVER w AS before, lead(para, 1, '') OVER w AS after FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE kind = 'formula'")
def formula_context(spark, sf_dir):
    w = W.partitionBy("doc_id").orderBy("pos")
    own = paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "paragraph_id", T.content_type(F.col("para")).alias("kind"), F.lag("para", 1, "").over(w).alias("before"), F.lead("para", 1, "").over(w).alias("after"))
    return own.filter("kind = 'formula'").select("doc_id", "paragraph_id", F.md5("before").alias("before"), F.md5("after").alias("after"))
