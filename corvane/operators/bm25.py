"""BM25 over a postings table.

score = sum over query terms of idf * tf / (tf + k1 * (1 - b + b * length / average)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)); statistics are the whole corpus', filters don't score, and a
repeated query term counts again. Lengths are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from corvane.functions.text import terms
from corvane.sources.shared import written

K1, B = 1.2, 0.75
MAX_BROADCAST = 10_000
#: Terms that are counted at once in a task.
AT_ONCE = 1 << 20
#: Cells of a matrix of items and terms, and queries of one matrix product, in a search.
CELLS_AT_ONCE, QUERIES_AT_ONCE = 1 << 20, 256
#: How far two scores may lie apart that round to the same nine places, with what the order of a sum changes.
MARGIN = 2e-9


def lengths(items: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return items.select(F.col(id_col).alias("id"), F.size(terms(F.col(text_col))).cast("long").alias("length"))


def postings(items: DataFrame, id_col: str = "id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """term, id, length, tf. Terms of one item lie in one row, so they are counted there, and no term is shuffled.
    unique: whether ids are known to be unique; if an id occurs twice, its rows' terms are added up by a shuffle."""
    each = items.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms")).select("id", F.size("terms").cast("long").alias("length"), "terms")
    if not unique and items.groupBy(id_col).count().filter("count > 1").limit(1).count():
        return each.select("id", "length", F.explode("terms").alias("term")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    return each.mapInArrow(counted, f"term string, id {dict(each.dtypes)['id']}, length long, tf long")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, terms) -> term, id, length, tf: AT_ONCE terms at a time, and an item at least."""
    for batch in batches:
        before = np.asarray(batch.column(2).offsets)[:-1]
        starts = np.flatnonzero(np.diff((before - before[:1]) // AT_ONCE, prepend=-1))
        for s, e in zip(starts, np.append(starts[1:], batch.num_rows), strict=False):
            part = batch.slice(s, e - s)
            codes, item = part.column(2).flatten().dictionary_encode(), np.repeat(np.arange(e - s), np.diff(np.asarray(part.column(2).offsets)))
            size = max(1, len(codes.dictionary))
            found, tf = np.unique(item * size + np.asarray(codes.indices), return_counts=True)
            rows = part.select([0, 1]).take(pa.array(found // size))
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(found % size)), *rows.columns, pa.array(tf)], names=["term", "id", "length", "tf"])


def statistics(items: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row: n, average."""
    return lengths(items, id_col, text_col).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query) -> query_id, term, times."""
    return queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def search(items: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", text_col: str = "text", keep: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best items of each query. keep: ids (column id) that may be hits.

    Texts are split once: what is written is a row an item, with its length and those of its terms that any query asks
    for. Statistics come from that table, and each task scores its items by matrix products and puts out the k best
    of each query. Queries of more than MAX_BROADCAST terms, and ids that occur twice, take joins and sums instead.
    """
    spark, asked = items.sparkSession, query_terms(queries)
    each = items.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms"))
    pairs = asked.limit(MAX_BROADCAST + 1).collect()  # MAX_BROADCAST + 1 at most
    few, words = len(pairs) <= MAX_BROADCAST, sorted({r["term"] for r in pairs})
    # terms are letters and digits alone, so they stand in an expression as they are
    listed = ", ".join(f"'{x}'" for x in words or [""])
    named = f"filter(terms, x -> x in ({listed}))" if few else "terms"
    own = each.select("id", F.size("terms").cast("long").alias("length"), F.expr(named).alias("terms"))
    own = written(spark, own, "search-items") if few else own
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    hits = own.filter(F.size("terms") > 0)
    if not few or hits.groupBy("id").count().filter("count > 1").limit(1).count():
        return _ranked(_joined(hits, asked, stats, few, keep), k)
    n, average = stats.first()  # one row
    df = dict(hits.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().collect())  # MAX_BROADCAST at most
    if keep is not None:
        hits = hits.join(keep.select("id"), "id", "left_semi")
    weights = [(q, t, times * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for q, t, times in pairs if t in df]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(own.dtypes)['id']}, score double"
    return _ranked(hits.mapInArrow(_best(weights, average, k, to_arrow_type(queries.schema["query_id"].dataType)), schema), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _joined(hits: DataFrame, asked: DataFrame, stats: DataFrame, few: bool, keep: DataFrame | None) -> DataFrame:
    """query_id, id, score of all items with a term of the query."""
    words = asked.select("term").distinct()
    each = hits.select("id", "length", F.explode("terms").alias("term"))
    hits = (each if few else each.join(words, "term", "left_semi")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    if keep is not None:
        hits = hits.join(keep.select("id"), "id", "left_semi")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return hits.join(F.broadcast(weights) if few else weights, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def _best(weights: list[tuple], average: float, k: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, length, terms) of the items of a task -> query_id, id, score of the k best of each query, given the
    (query_id, term, weight) of all queries."""
    queries, words = ({x: n for n, x in enumerate(dict.fromkeys(r[c] for r in weights))} for c in (0, 1))
    row, column, weight = np.array([queries[r[0]] for r in weights], np.int64), np.array([words[r[1]] for r in weights], np.int64), np.array([r[2] for r in weights])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, found = [*queries], pa.array([*words], pa.string())
        blocks = [_Block(row, column, weight, s, min(s + QUERIES_AT_ONCE, len(named))) for s in range(0, len(named), QUERIES_AT_ONCE)]
        size = max(1, CELLS_AT_ONCE // max(1, len(words), min(QUERIES_AT_ONCE, len(named))))
        for batch in batches:
            for s in range(0, batch.num_rows if len(words) else 0, size):
                part = batch.slice(s, size)
                lists, n = part.column(2), part.num_rows
                at = np.asarray(pc.index_in(lists.flatten(), value_set=found))
                item = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
                # an asked term that no item holds has no weight
                known = at >= 0
                tf = np.bincount(item[known] * len(words) + at[known], minlength=n * len(words)).reshape(n, len(words)).astype(np.float64)
                share = tf / (tf + (K1 * (1 - B + B * np.asarray(part.column(1)) / average))[:, None])
                for block in blocks:
                    block.add(part.column(0), share, k)
        for block in blocks:
            if block.ids is not None and len(block.ids):
                yield pa.RecordBatch.from_arrays([pa.array([named[q] for q in block.query], kind), block.ids, pa.array(block.score)], names=["query_id", "id", "score"])

    return run


class _Block:
    """The best items so far of some queries."""

    def __init__(self, row: np.ndarray, column: np.ndarray, weight: np.ndarray, first: int, end: int):
        own = np.flatnonzero((row >= first) & (row < end))
        self.first, self.columns = first, np.unique(column[own])
        self.weights = np.zeros((len(self.columns), end - first))
        self.weights[np.searchsorted(self.columns, column[own]), row[own] - first] = weight[own]
        self.reached, self.query, self.score, self.ids = np.zeros(end - first), np.zeros(0, np.int64), np.zeros(0), None

    def add(self, ids: pa.Array, share: np.ndarray, k: int) -> None:
        scores = share[:, self.columns] @ self.weights
        item, query = np.nonzero((scores > 0) & (scores >= self.reached - MARGIN))
        if not len(item):
            return
        self.ids = ids.take(pa.array(item)) if self.ids is None else pa.concat_arrays([self.ids, ids.take(pa.array(item))])
        self.query, self.score = np.concatenate([self.query, self.first + query]), np.concatenate([self.score, scores[item, query]])
        place = np.asarray(pc.rank(self.ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first"))
        order = np.lexsort((place, -np.round(self.score, 9), self.query))
        at = np.arange(len(order))
        start = np.maximum.accumulate(np.where(np.diff(self.query[order], prepend=-1) != 0, at, 0))
        last = at - start == k - 1
        self.reached[self.query[order][last] - self.first] = self.score[order][last]
        kept = order[at - start < k]
        self.query, self.score, self.ids = self.query[kept], self.score[kept], self.ids.take(pa.array(kept))
