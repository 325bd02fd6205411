"""The search cache as an append-only log of entries; the last entry of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.text import trimmed

TTL_SECONDS = 3600


def cache_key(query: Column, filters: Column, k: Column, alpha: Column, mode: Column) -> Column:
    """Digest of the query's normal form and all that its result depends on. filters: JSON with sorted keys."""
    return F.sha2(F.concat_ws(":", F.lower(trimmed(query)), filters, k.cast("string"), alpha.cast("string"), mode), 256)


def latest(entries: DataFrame, by: str = "key", order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The last entry of each key: an upsert on an append-only table."""
    last = F.row_number().over(W.partitionBy(by).orderBy(*(F.desc(c) for c in order)))
    return entries.withColumn("__at", last).filter("__at = 1").drop("__at")


def live(entries: DataFrame, as_of: float) -> DataFrame:
    """Entries that a read returns: an age of just the time to live still counts."""
    return entries.filter(F.lit(as_of) - F.col("created_at") <= F.col("ttl_seconds"))


def expired(entries: DataFrame, as_of: float) -> DataFrame:
    return entries.filter(F.col("created_at") + F.col("ttl_seconds") < F.lit(as_of))


def invalidated(entries: DataFrame, doc_id: str) -> DataFrame:
    """Entries that stay when a document's are dropped: those whose results don't name it."""
    return entries.filter(~F.col("results").contains(doc_id))


def statistics(entries: DataFrame, as_of: float) -> DataFrame:
    """One row: total, expired, hits, size_mb."""
    gone = F.col("created_at") + F.col("ttl_seconds") < F.lit(as_of)
    return entries.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("expired"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("hits"), (F.coalesce(F.sum(F.length("results")), F.lit(0)) / 1048576.0).alias("size_mb")
    )


def latency(log: DataFrame, by: str, order: list[str]) -> DataFrame:
    """log (hit, ms) with running means of the misses' latency, and the running hit rate in percent.

    mean_ms divides by misses; literal_ms by hits and misses, with only misses adding (a known skew).
    """
    own = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(own)
    misses = F.sum(F.when(~F.col("hit"), 1).otherwise(0)).over(own)
    total = F.sum(F.when(~F.col("hit"), F.col("ms")).otherwise(0.0)).over(own)
    return log.withColumn("mean_ms", F.try_divide(total, misses)).withColumn("literal_ms", total / n).withColumn("hit_rate", 100.0 * (n - misses) / n)
