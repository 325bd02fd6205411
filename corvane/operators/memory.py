"""Memories: recall, ranking, retention, statistics. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.text import is_core_fact
from corvane.functions.times import micros
from corvane.functions.vectors import cosine

HALF_LIFE_DAYS = 7.0
MIN_SCORE = 0.4
CORE_BOOST = 0.3
RETENTION_DAYS = 30


def memory_id(key: Column, ts: Column) -> Column:
    return F.md5(F.concat_ws(":", key, ts.cast("string")))


def age_days(ts: Column, as_of: Column) -> Column:
    return (micros(as_of) - micros(ts)) / F.lit(86_400_000_000.0)


def decayed(score: Column, ts: Column, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Halved every half-life; a null score stays null."""
    return score * F.pow(F.lit(0.5), age_days(ts, as_of) / half_life)


def boosted(score: Column, category: Column) -> Column:
    return F.when(F.lower(category) == "core", F.least(F.lit(1.0), score + CORE_BOOST)).otherwise(score)


def ranked(memories: DataFrame, as_of: Column, limit: int = 5, min_score: float = MIN_SCORE, decay: bool = True, boost: bool = True) -> DataFrame:
    """memories with `final`, the best first: decayed, boosted, without autosaved answers or low scores."""
    score = decayed(F.col("score"), F.col("ts"), as_of) if decay else F.col("score")
    base = F.coalesce(score, F.lit(min_score))
    final = boosted(base, F.col("category")) if boost else base
    own = memories.withColumn("final", final).filter(~F.col("key").startswith("assistant_") & ~F.isnan("final") & (F.col("final") >= min_score))
    return own.orderBy(F.desc(F.round("final", 9)), "id").limit(limit)


def rendered(top: DataFrame) -> DataFrame:
    """One row, context: the list as a prompt takes it ('' if it is empty). top: a bounded list."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("final")).alias("o"), "id", F.concat(F.lit("- "), "key", F.lit(": "), "content").alias("line")))), lambda x: x["line"])
    return top.agg(F.when(F.count(F.lit(1)) == 0, "").otherwise(F.concat(F.lit("[Memory context]\n"), F.array_join(lines, "\n"), F.lit("\n"))).alias("context"))


def recall(memories: DataFrame, query: list[float], limit: int = 5, session: str | None = None) -> DataFrame:
    """The most similar of the newest 3 * limit memories; those without a vector are skipped after that limit."""
    own = memories if session is None else memories.filter(F.col("session_id") == session)
    newest = own.orderBy(F.desc("ts"), "id").limit(3 * limit)
    scored = newest.filter("embedding is not null").withColumn("score", cosine(F.col("embedding"), F.array(*map(F.lit, query))))
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def expired(memories: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """What a retention run deletes: older than `days` and not core."""
    return memories.filter((F.col("ts") < as_of - F.make_dt_interval(F.lit(days))) & (F.col("category") != "core"))


def retained(memories: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return memories.filter(~((F.col("ts") < as_of - F.make_dt_interval(F.lit(days))) & (F.col("category") != "core")))


def by_category(memories: DataFrame, category: str, limit: int = 10) -> DataFrame:
    return memories.filter(F.col("category") == category).orderBy(F.desc("ts"), "id").limit(limit)


def statistics(memories: DataFrame) -> DataFrame:
    """One row a category: n, oldest, newest."""
    return memories.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def with_core_facts(messages: DataFrame) -> DataFrame:
    """(key, content, category) of the facts that user messages (text) state about themselves."""
    return messages.filter(is_core_fact(F.col("text"))).select(F.lit("user_identity_fact").alias("key"), F.concat(F.lit("User mentioned: "), "text").alias("content"), F.lit("core").alias("category"))


#: A session's time is cut into slots of so many units, within which memories are numbered by one task.
SLOT = 3600


def recalled(memories: DataFrame, messages: DataFrame, limit: int = 5, slot: float = SLOT) -> DataFrame:
    """message_id, id, score, rank: for each message (message_id, session_id, at, query_vector) as recall() among the
    memories (id, session_id, at, embedding) of its session before it: an as-of join for all messages at once.

    Memories of a session are numbered in the order of time, within slots of time, whose counts are summed up
    first, so no session is ordered by one task. A message knows by the same sums how many memories come before it,
    and so the numbers of the newest 3 * limit; blocks of as many numbers make that an equi-join on two blocks at most.
    A memory of the message's own time isn't before it. Null sessions or times recall nothing; of memories of one time
    the smaller id is the newer.
    """
    wide = 3 * limit
    place = F.floor(F.col("at") / F.lit(slot)).cast("long")
    own = memories.filter("session_id is not null and at is not null").select("session_id", "at", "id", "embedding", place.alias("slot"))
    asked = messages.filter("session_id is not null and at is not null").select("session_id", "at", "message_id", "query_vector", place.alias("slot"))
    counts = own.groupBy("session_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    # slots that only messages are in have no memories of their own
    slots = counts.unionByName(asked.select("session_id", "slot").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("session_id", "slot").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("session_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = slots.select("session_id", "slot", before.alias("earlier"))
    numbered = own.join(slots, ["session_id", "slot"]).withColumn("number", F.col("earlier") + F.row_number().over(W.partitionBy("session_id", "slot").orderBy("at", F.desc("id"))) - 1)
    both = own.select("session_id", "slot", "at", F.lit(1).alias("memory"), F.lit(None).cast(dict(messages.dtypes)["message_id"]).alias("message_id")).unionByName(
        asked.select("session_id", "slot", "at", F.lit(0).alias("memory"), "message_id")
    )
    within = F.sum("memory").over(W.partitionBy("session_id", "slot").orderBy("at", "memory").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = both.withColumn("within", within).filter("memory = 0").join(slots, ["session_id", "slot"]).select("message_id", (F.col("earlier") + F.col("within")).alias("upto"))
    at = asked.join(ends, "message_id").filter("upto > 0").withColumn("since", F.greatest(F.col("upto") - wide, F.lit(0)))
    blocks = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("since") / wide), F.floor((F.col("upto") - 1) / wide)))).select("session_id", "block", "message_id", "query_vector", "since", "upto")
    near = numbered.withColumn("block", F.floor(F.col("number") / wide)).join(blocks, ["session_id", "block"]).filter("number >= since and number < upto and embedding is not null")
    scored = near.select("message_id", "id", cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    rank = F.row_number().over(W.partitionBy("message_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)
