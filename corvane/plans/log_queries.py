"""Memory, cache, sequence and session queries over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import sentences as split_sentences
from corvane.functions.times import micros
from corvane.operators import cache, chunker, memory, sequence
from corvane.plans.base import CORPUS, query, trim
from corvane.sources.corpus import paragraphs
from corvane.sources.tables import table

AS_OF = "2024-01-31 00:00:00"
EPOCH = 1706659200.0

MEMORIES = "WITH m AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'assistant_' ELSE '' END || event_type || '_' || user_id AS key, props AS content, CASE event_type WHEN 'purchase' THEN 'core' WHEN 'signup' THEN 'Core' ELSE 'general' END AS category, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 500 END AS score FROM events)"


def _memories(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.when(kind == "error", "assistant_").otherwise(""), kind, F.lit("_"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("content"),
        F.when(kind == "purchase", "core").when(kind == "signup", "Core").otherwise("general").alias("category"),
        "ts",
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value") / 500).alias("score"),
    )


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0::DOUBLE"
RANKED = f""", d AS (SELECT *, coalesce(score * pow(0.5::DOUBLE, {AGE} / 7.0::DOUBLE), 0.4) AS base FROM m),
b AS (SELECT *, CASE WHEN lower(category) = 'core' THEN least(1.0, base + 0.3) ELSE base END AS final FROM d)
"""


@query("memory_decay_rank", MEMORIES + RANKED + "SELECT id, key, round(final, 6) AS final FROM b WHERE NOT starts_with(key, 'assistant_') AND final >= 0.4 ORDER BY round(final, 9) DESC, id LIMIT 50")
def memory_decay_rank(spark, sf_dir):
    return memory.ranked(_memories(spark, sf_dir), _as_of(), 50).select("id", "key", F.round("final", 6).alias("final"))


@query("memory_simple_rank", MEMORIES + "SELECT id, key, round(coalesce(score, 0.4), 6) AS final FROM m WHERE NOT starts_with(key, 'assistant_') AND coalesce(score, 0.4) >= 0.4 ORDER BY round(coalesce(score, 0.4), 9) DESC, id LIMIT 5")
def memory_simple_rank(spark, sf_dir):
    return memory.ranked(_memories(spark, sf_dir), _as_of(), 5, decay=False, boost=False).select("id", "key", F.round("final", 6).alias("final"))


@query("memory_context", MEMORIES + RANKED + ", t AS (SELECT * FROM b WHERE NOT starts_with(key, 'assistant_') AND final >= 0.4 ORDER BY round(final, 9) DESC, id LIMIT 5) SELECT '[Memory context]' || chr(10) || string_agg('- ' || key || ': ' || content, chr(10) ORDER BY final DESC, id) || chr(10) AS context FROM t")
def memory_context(spark, sf_dir):
    return memory.rendered(memory.ranked(_memories(spark, sf_dir), _as_of(), 5))


@query("memory_recall", MEMORIES + ", n AS (SELECT * FROM m ORDER BY ts DESC, id LIMIT 30000), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT n.id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM n JOIN embeddings e ON e.vec_id = n.id, q ORDER BY 2 DESC, 1 LIMIT 10000")
def memory_recall(spark, sf_dir):
    """The newest 30,000 memories, those with a vector, by similarity."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = [float(x) for x in vectors.filter("id = 0").first()["embedding"]]  # the query, one row
    return memory.recall(_memories(spark, sf_dir).join(vectors, "id", "left"), asked, 10000).select("id", F.round("score", 6).alias("score"))


RECALLED = """WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id % 40 AS session_id, conv_id // 3 * 10 + turn AS moment, role, (conv_id * 7 + turn * 13) % (SELECT count(*) FROM embeddings) AS vec_id FROM conversations),
v AS (SELECT t.*, e.embedding::DOUBLE[] AS embedding FROM t JOIN embeddings e USING (vec_id)),
n AS (SELECT q.id AS message_id, m.id, m.embedding, q.embedding AS query_vector, row_number() OVER (PARTITION BY q.id ORDER BY m.moment DESC, m.id) AS newest FROM v q JOIN v m ON m.session_id = q.session_id AND m.moment < q.moment WHERE q.role = 'user' AND m.role = 'assistant'),
s AS (SELECT message_id, id, list_cosine_similarity(embedding, query_vector) AS score FROM n WHERE newest <= 9)
SELECT message_id, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 3"""


@query("memory_recall_messages", RECALLED)
def memory_recall_messages(spark, sf_dir):
    """What every user message recalls of its session's earlier answers."""
    known = table(spark, sf_dir, "embeddings")
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 40).alias("session_id"),
        (F.floor(F.col("conv_id") / 3) * 10 + F.col("turn")).alias("at"),
        "role",
        F.pmod(F.col("conv_id") * 7 + F.col("turn") * 13, F.lit(known.count())).alias("vec_id"),
    )
    own = turns.join(known.select("vec_id", "embedding"), "vec_id")
    messages = own.filter("role = 'user'").select(F.col("id").alias("message_id"), "session_id", "at", F.col("embedding").alias("query_vector"))
    out = memory.recalled(own.filter("role = 'assistant'").select("id", "session_id", "at", "embedding"), messages, 3, slot=100)
    return out.select("message_id", "id", F.round("score", 6).alias("score"), "rank")


@query("memory_retention", MEMORIES + f"SELECT category, count(*)::BIGINT AS deleted FROM m WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY AND category <> 'core' GROUP BY 1")
def memory_retention(spark, sf_dir):
    return memory.expired(_memories(spark, sf_dir), _as_of(), 15).groupBy("category").agg(F.count(F.lit(1)).alias("deleted"))


@query("memory_retained", MEMORIES + f"SELECT id FROM m WHERE NOT (ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY AND category <> 'core')")
def memory_retained(spark, sf_dir):
    return memory.retained(_memories(spark, sf_dir), _as_of(), 15).select("id")


@query("memory_stats", MEMORIES + "SELECT category, count(*)::BIGINT AS n, min(ts) AS oldest, max(ts) AS newest FROM m GROUP BY 1")
def memory_stats(spark, sf_dir):
    return memory.statistics(_memories(spark, sf_dir))


@query("memory_by_category", MEMORIES + "SELECT id, key, content FROM m WHERE category = 'core' ORDER BY ts DESC, id LIMIT 10")
def memory_by_category(spark, sf_dir):
    return memory.by_category(_memories(spark, sf_dir), "core").select("id", "key", "content")


@query("memory_ids", MEMORIES + "SELECT id, md5(key || ':' || strftime(ts, '%Y-%m-%d')) AS memory_id FROM m")
def memory_ids(spark, sf_dir):
    own = _memories(spark, sf_dir)
    return own.select("id", memory.memory_id(F.col("key"), F.date_format("ts", "yyyy-MM-dd")).alias("memory_id"))


# --- cache

ENTRIES = "WITH c AS (SELECT event_id, event_type || '_' || user_id AS key, props AS results, epoch(ts) AS created_at, 3600 + (user_id % 100) * 3600 AS ttl_seconds, event_id % 7 AS access_count FROM events)"


def _entries(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("results"),
        (micros(F.col("ts")) / 1e6).alias("created_at"),
        (3600 + (F.col("user_id") % 100) * 3600).alias("ttl_seconds"),
        (F.col("event_id") % 7).alias("access_count"),
    )


@query("cache_key", rf"""SELECT conv_id, turn, sha256(lower({trim('text')}) || ':' || '{{"doc_id":' || conv_id || '}}' || ':5:0.5:weighted') AS key FROM conversations""")
def cache_key(spark, sf_dir):
    filters = F.concat(F.lit('{"doc_id":'), F.col("conv_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cache.cache_key(F.col("text"), filters, F.lit(5), F.lit(0.5), F.lit("weighted")).alias("key"))


@query("cache_latest", ENTRIES + "SELECT key, event_id FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) = 1")
def cache_latest(spark, sf_dir):
    return cache.latest(_entries(spark, sf_dir), "key", ("created_at", "event_id")).select("key", "event_id")


@query("cache_live", ENTRIES + f"SELECT event_id FROM c WHERE {EPOCH}::DOUBLE - created_at <= ttl_seconds")
def cache_live(spark, sf_dir):
    return cache.live(_entries(spark, sf_dir), EPOCH).select("event_id")


@query("cache_expired", ENTRIES + f"SELECT event_id FROM c WHERE created_at + ttl_seconds < {EPOCH}::DOUBLE")
def cache_expired(spark, sf_dir):
    return cache.expired(_entries(spark, sf_dir), EPOCH).select("event_id")


@query("cache_hit_stats", ENTRIES + f"SELECT count(*)::BIGINT AS total, count(*) FILTER (created_at + ttl_seconds < {EPOCH}::DOUBLE)::BIGINT AS expired, coalesce(sum(access_count), 0)::BIGINT AS hits, round(coalesce(sum(length(results)), 0) / 1048576.0::DOUBLE, 6) AS size_mb FROM c")
def cache_hit_stats(spark, sf_dir):
    return cache.statistics(_entries(spark, sf_dir), EPOCH).select("total", "expired", "hits", F.round("size_mb", 6).alias("size_mb"))


@query("cache_invalidate_doc", ENTRIES + "SELECT event_id FROM c WHERE NOT contains(results, '7')")
def cache_invalidate_doc(spark, sf_dir):
    return cache.invalidated(_entries(spark, sf_dir), "7").select("event_id")


@query(
    "latency_running_mean",
    """SELECT event_id, round(total / nullif(misses, 0), 6) AS mean_ms, round(total / n, 6) AS literal_ms, round(100.0::DOUBLE * (n - misses) / n, 6) AS hit_rate FROM (
SELECT event_id, count(*) OVER w AS n, sum((event_type <> 'view')::INT) OVER w AS misses, sum(CASE WHEN event_type <> 'view' THEN value ELSE 0 END) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
)
def latency_running_mean(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "view").alias("hit"), F.col("value").alias("ms"))
    out = cache.latency(log, "user_id", ["ts", "event_id"])
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("mean_ms", "literal_ms", "hit_rate")))


# --- sequences

CALLS = """WITH e AS (SELECT event_id, user_id, event_type AS tool, event_type = 'error' AS failed, ts, epoch_us(ts) // 3600000000 AS iteration FROM events),
q AS (SELECT *, coalesce(tool = lag(tool, 1) OVER w AND tool = lag(tool, 2) OVER w, false) AS np,
  coalesce(tool <> lag(tool, 1) OVER w AND tool = lag(tool, 2) OVER w AND lag(tool, 1) OVER w = lag(tool, 3) OVER w, false) AS pp,
  sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, run, tool ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM q),
s AS (SELECT *, failed AND max(n) OVER (PARTITION BY user_id, run ORDER BY ts ROWS UNBOUNDED PRECEDING) >= 3 AS fs FROM r)
"""


def _calls(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    same = F.lit("same")
    return e.select("event_id", F.col("user_id").alias("session_id"), micros(F.col("ts")).alias("seq"), F.floor(micros(F.col("ts")) / 3600000000).alias("iteration"), F.col("event_type").alias("tool"), same.alias("args_hash"), same.alias("result_hash"), (F.col("event_type") != "error").alias("success"))


@query("loop_no_progress", CALLS + "SELECT event_id, np AS fired FROM s")
def loop_no_progress(spark, sf_dir):
    return _calls(spark, sf_dir).withColumn("fired", sequence.no_progress(3)).select("event_id", "fired")


@query("loop_ping_pong", CALLS + "SELECT event_id, pp AS fired FROM s")
def loop_ping_pong(spark, sf_dir):
    return _calls(spark, sf_dir).withColumn("fired", sequence.ping_pong(2)).select("event_id", "fired")


@query("loop_failure_streak", CALLS + "SELECT event_id, fs AS fired FROM s")
def loop_failure_streak(spark, sf_dir):
    return sequence.failure_streak(_calls(spark, sf_dir), 3).select("event_id", F.col("streak").alias("fired"))


RULES = "CASE WHEN np THEN 'no_progress' WHEN pp THEN 'ping_pong' WHEN fs THEN 'failure_streak' END AS rule"
VERDICT = "CASE WHEN rule IS NULL THEN 'CONTINUE' WHEN count(rule) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 THEN 'INJECT_WARNING' ELSE 'HARD_STOP' END AS verdict"
VERDICTS = CALLS + f", v AS (SELECT *, {RULES} FROM s)"


@query("loop_verdict", VERDICTS + f" SELECT event_id, rule, {VERDICT} FROM v")
def loop_verdict(spark, sf_dir):
    return sequence.verdicts(_calls(spark, sf_dir)).select("event_id", "rule", "verdict")


@query("loop_verdict_per_iteration", CALLS + f", v AS (SELECT *, {RULES} FROM s QUALIFY row_number() OVER (PARTITION BY user_id, iteration ORDER BY ts DESC) = 1) SELECT event_id, rule, {VERDICT} FROM v")
def loop_verdict_per_iteration(spark, sf_dir):
    return sequence.verdicts(_calls(spark, sf_dir), per_iteration=True).select("event_id", "rule", "verdict")


@query(
    "history_compact",
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
h AS (SELECT conv_id, -1 AS p, 'system' AS role, 'Previous conversation: ' || concat_ws(', ', CASE WHEN u > 0 THEN u || ' user queries' END, CASE WHEN a > 0 THEN a || ' assistant responses' END) || '.' AS text FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM c WHERE n > 4 AND back > 2 GROUP BY 1)),
b AS (SELECT conv_id, n - back AS p, role, text FROM c WHERE n <= 4 OR back <= 2 UNION ALL SELECT * FROM h)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1)::INT AS pos, role, text FROM b""",
)
def history_compact(spark, sf_dir):
    """Histories of more than 4 messages become a summary and their last 2."""
    return sequence.compacted(table(spark, sf_dir, "conversations"), 4, 2)


@query("history_trim", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, (first(role) OVER (PARTITION BY conv_id ORDER BY turn)) = 'system' AS head FROM conversations) SELECT conv_id, turn, role FROM c WHERE (up = 1 AND head) OR back <= CASE WHEN head THEN 3 ELSE 4 END")
def history_trim(spark, sf_dir):
    return sequence.trimmed_history(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


@query("chat_history_first", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def chat_history_first(spark, sf_dir):
    return sequence.chat_history(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "text")


@query("chat_history_newest", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def chat_history_newest(spark, sf_dir):
    return sequence.chat_history(table(spark, sf_dir, "conversations"), 3, newest=True).select("conv_id", "turn", "text")


@query("session_list", "SELECT conv_id, count(*)::BIGINT AS message_count, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1")
def session_list(spark, sf_dir):
    return sequence.sessions(table(spark, sf_dir, "conversations"))


@query("role_counts", "SELECT conv_id, count(*) FILTER (role = 'user')::BIGINT AS user, count(*) FILTER (role = 'assistant')::BIGINT AS assistant, count(*) FILTER (role = 'tool')::BIGINT AS tool FROM conversations GROUP BY 1")
def role_counts(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    return own.groupBy("conv_id").agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("user", "assistant", "tool")))


@query("agent_counters", "SELECT user_id, count(*)::BIGINT AS requests, count(*) FILTER (event_type <> 'view')::BIGINT AS tool_calls, count(*) FILTER (event_type = 'error')::BIGINT AS failures FROM events GROUP BY 1")
def agent_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") != "view").alias("tool_calls"), F.count_if(F.col("event_type") == "error").alias("failures"))


# --- folds


@query("semantic_chunks")
def semantic_chunks(spark, sf_dir):
    # places of sentences in reading order, as their offsets give it, without counting characters
    own = paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.posexplode(split_sentences(F.col("para"))).alias("k", "text"))
    own = own.withColumn("seq", F.col("pos") * F.lit(1 << 32) + F.col("k"))
    return chunker.semantic_chunks(own.select("doc_id", "seq", "text")).drop("text")


@query(
    "batched_summary",
    CORPUS + "SELECT doc_id, CASE WHEN count(*) = 1 THEN any_value(para) ELSE left(string_agg(para, chr(10) || chr(10) ORDER BY pos), 200) END AS summary FROM paras GROUP BY 1",
)
def batched_summary(spark, sf_dir):
    """The fold with the extractive plug-in: each batch's summary begins with the summary so far."""
    from corvane.operators.plugins import extractive_summary

    own = paragraphs(table(spark, sf_dir, "documents")).select("doc_id", F.col("pos").alias("rank"), F.col("para").alias("text"))
    return chunker.batched_summaries(own, extractive_summary)


@query(
    "session_log",
    """WITH l AS (SELECT user_id AS session_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, ts, props AS metadata FROM events),
g AS (SELECT session_id, max(ts) AS gone FROM l WHERE op = 'delete' GROUP BY 1)
SELECT session_id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(metadata, ts) AS metadata FROM l LEFT JOIN g USING (session_id) WHERE op <> 'delete' AND (gone IS NULL OR ts > gone) GROUP BY 1""",
)
def session_log(spark, sf_dir):
    """Live sessions after a log of creates, updates and deletes."""
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return sequence.sessions_of_log(table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), kind.alias("op"), "ts", F.col("props").alias("metadata")))
