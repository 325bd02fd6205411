"""Fusion of a vector and a keyword result list, for many queries at once.

Lists are (query_id, id, score, rank). Ties: the vector list's order first, then ids of the keyword
list alone in theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RRF_K = 60


def _both(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    v = vector.select("query_id", "id", F.col("score").alias("v_score"), F.col("rank").alias("v_rank"))
    b = keyword.select("query_id", "id", F.col("score").alias("b_score"), F.col("rank").alias("b_rank"))
    return v.join(b, ["query_id", "id"], "full_outer")


def _ranked(fused: DataFrame, k: int | None) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("v_rank"), F.asc_nulls_last("b_rank"), "id")
    out = fused.withColumn("rank", F.row_number().over(order))
    return (out if k is None else out.filter(F.col("rank") <= k)).select("query_id", "id", "score", "rank")


def weighted(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, k: int | None = None) -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword, each divided by its list's largest score."""
    per_query = W.partitionBy("query_id")

    def scaled(name: str) -> Column:
        most = F.max(name).over(per_query)
        return F.when(most > 0, F.coalesce(F.col(name), F.lit(0.0)) / most).otherwise(0.0)

    return _ranked(_both(vector, keyword).withColumn("score", alpha * scaled("v_score") + (1 - alpha) * scaled("b_score")), k)


def reciprocal_rank(vector: DataFrame, keyword: DataFrame, constant: int = RRF_K, k: int | None = None) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists that hold an id."""
    part = lambda name: F.coalesce(1.0 / (constant + F.col(name)), F.lit(0.0))
    return _ranked(_both(vector, keyword).withColumn("score", part("v_rank") + part("b_rank")), k)
