"""Patterns in tool-call logs, and histories of messages.

Calls are (session_id, seq, iteration, tool, args_hash, result_hash, success); every rule is a window
over a session in the order of seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _order(by: str, order: str):
    return W.partitionBy(by).orderBy(order)


def no_progress(n: int = 3, by: str = "session_id", order: str = "seq") -> Column:
    """The last n calls are the same call with the same result; n = 0 switches it off."""
    if n == 0:
        return F.lit(False)
    n = max(n, 2)
    own = F.struct(F.lower("tool").alias("t"), "args_hash", "result_hash")
    same = F.lit(True)
    for k in range(1, n):
        same = same & F.coalesce(own == F.lag(own, k).over(_order(by, order)), F.lit(False))
    return same


def ping_pong(cycles: int = 2, by: str = "session_id", order: str = "seq") -> Column:
    """The last 2 * cycles calls (4 at least) alternate between two tools."""
    if cycles < 2:
        return F.lit(False)
    tool, w = F.lower("tool"), _order(by, order)
    out = tool != F.lag(tool, 1).over(w)
    for k in range(2, 2 * cycles):
        out = out & (tool == F.lag(tool, k).over(w) if k % 2 == 0 else F.lag(tool, 1).over(w) == F.lag(tool, k).over(w))
    return F.coalesce(out, F.lit(False))


def failure_streak(calls: DataFrame, n: int = 3, by: str = "session_id", order: str = "seq") -> DataFrame:
    """calls with `streak`: in the run of failures that ends here some tool has n or more."""
    w = _order(by, order)
    run = F.sum(F.when(F.col("success"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    own = calls.withColumn("__run", run)
    in_run = W.partitionBy(by, "__run", "tool").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumn("__n", F.sum(F.when(F.col("success"), 0).otherwise(1)).over(in_run))
    most = F.max("__n").over(W.partitionBy(by, "__run").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn("streak", ~F.col("success") & (most >= n)).drop("__run", "__n")


def verdicts(calls: DataFrame, repeats: int = 3, cycles: int = 2, failures: int = 3, by: str = "session_id", order: str = "seq", per_iteration: bool = False) -> DataFrame:
    """calls with rule (the first of no_progress, ping_pong, failure_streak that fires, or null) and
    verdict: CONTINUE, INJECT_WARNING at a session's first firing, HARD_STOP at each later one.

    per_iteration: only the last call of an iteration is judged, as one iteration may log many.
    """
    own = failure_streak(calls, failures, by, order).withColumn("no_progress", no_progress(repeats, by, order)).withColumn("ping_pong", ping_pong(cycles, by, order))
    if per_iteration:
        own = own.withColumn("__last", F.row_number().over(W.partitionBy(by, "iteration").orderBy(F.desc(order)))).filter("__last = 1").drop("__last")
    rule = F.when(F.col("no_progress"), "no_progress").when(F.col("ping_pong"), "ping_pong").when(F.col("streak"), "failure_streak")
    own = own.withColumn("rule", rule)
    fired = F.count("rule").over(_order(by, order).rowsBetween(W.unboundedPreceding, 0))
    verdict = F.when(F.col("rule").isNull(), "CONTINUE").when(fired == 1, "INJECT_WARNING").otherwise("HARD_STOP")
    return own.withColumn("verdict", verdict).drop("no_progress", "ping_pong", "streak")


def compacted(messages: DataFrame, most: int = 20, keep: int = 4, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """by, pos, role, text: a history over `most` messages becomes one summary and its last `keep`."""
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    back = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    own = messages.withColumn("__n", n).withColumn("__back", back)
    kept = own.filter((F.col("__n") <= most) | (F.col("__back") <= keep)).select(by, (F.col("__n") - F.col("__back")).alias("__pos"), "role", "text", "__n")
    old = own.filter((F.col("__n") > most) & (F.col("__back") > keep))
    part = lambda role, name: F.when(F.count_if(F.col("role") == role) > 0, F.concat(F.count_if(F.col("role") == role).cast("string"), F.lit(f" {name}")))
    # the summary's words are fixed values
    summary = F.concat(F.lit("Previous conversation: "), F.concat_ws(", ", part("user", "user queries"), part("assistant", "assistant responses"), part("tool", "tool results")), F.lit("."))
    heads = old.groupBy(by).agg(summary.alias("text"), F.max("__n").alias("__n")).select(by, F.lit(-1).alias("__pos"), F.lit("system").alias("role"), "text", "__n")
    both = kept.unionByName(heads)
    return both.select(by, (F.row_number().over(W.partitionBy(by).orderBy("__pos")) - 1).alias("pos"), "role", "text")


def trimmed_history(messages: DataFrame, most: int = 20, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last `most` messages, a leading system message counted as one of them and kept."""
    up, down = W.partitionBy(by).orderBy(order), W.partitionBy(by).orderBy(F.desc(order))
    own = messages.withColumn("__back", F.row_number().over(down)).withColumn("__at", F.row_number().over(up)).withColumn("__head", F.first("role").over(up) == "system")
    keep = (F.col("__at") == 1) & F.col("__head") | (F.col("__back") <= F.when(F.col("__head"), most - 1).otherwise(most))
    return own.filter(keep).drop("__back", "__at", "__head")


def chat_history(messages: DataFrame, limit: int = 50, newest: bool = False, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The oldest `limit` messages of each session (or its newest)."""
    at = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order) if newest else F.asc(order)))
    return messages.withColumn("__at", at).filter(F.col("__at") <= limit).drop("__at")


def sessions(messages: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.groupBy(by).agg(F.count(F.lit(1)).alias("message_count"), F.min(order).alias("first"), F.max(order).alias("last"))


def sessions_of_log(log: DataFrame) -> DataFrame:
    """session_id, created_at, updated_at, metadata of the live sessions of an append-only log (session_id, op,
    ts, metadata), op being create, update or delete.

    A delete ends a session, and what comes later begins a new one; the last metadata given counts. An
    update of a session that isn't there creates it. Of one time, updates come first and deletes last.
    """
    at = F.struct("ts", F.when(F.col("op") == "delete", 2).when(F.col("op") == "create", 1).otherwise(0))
    gone = log.filter("op = 'delete'").groupBy("session_id").agg(F.max(at).alias("__gone"))
    own = log.filter("op <> 'delete'").withColumn("__at", at).join(gone, "session_id", "left").filter("__gone is null or __at > __gone")
    return own.groupBy("session_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("metadata", F.struct("__at", "metadata")).alias("metadata"))
