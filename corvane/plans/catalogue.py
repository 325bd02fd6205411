"""All named queries of the engine, and their DuckDB SQL."""

from corvane.plans import corpus_queries, log_queries, retrieval_queries, stream_queries, text_queries
from corvane.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus_queries", "log_queries", "retrieval_queries", "stream_queries", "text_queries"]
