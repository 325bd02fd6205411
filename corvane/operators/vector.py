"""Exact vector search and vector aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.vectors import cosine, doubles

#: Queries that a task holds at once; and cells.
MAX_QUERIES = 10_000
MAX_CELLS = 65_536
#: Rows of one part; rows and queries of one matrix product.
PART_ROWS, ROWS_AT_ONCE, QUERIES_AT_ONCE = 50_000, 4096, 512
#: How far a product's score may lie from the score by cosine(), and two scores that round to the same nine places.
MARGIN = 2e-9


def top_k(vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, score of the k nearest to one vector: a scan with a bounded heap in each task."""
    own = vectors if where is None else vectors.filter(where)
    scored = own.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), F.array(*map(F.lit, query))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


class _Vectors:
    """Vectors as matrices, one for each length; null ones, and ones with a null component, are in none."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        n = len(column)
        self.size, self.place, self.norm, self.matrix = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), {}
        size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        if column.flatten().null_count:
            size[np.asarray(pc.list_parent_indices(column))[np.asarray(column.flatten().is_null())]] = 0
        for k in np.unique(size[size > 0]):
            at = np.flatnonzero(size == k)
            own = np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), k)
            self.size[at], self.place[at], self.norm[at], self.matrix[int(k)] = k, np.arange(len(at)), np.sqrt(_in_order(own, own)), own

    def products(self, other: _Vectors) -> np.ndarray:
        """The score of each pair, summed in any order; NaN counts as the largest."""
        out = np.zeros((len(self.size), len(other.size)))
        for k in self.matrix.keys() & other.matrix.keys():
            a, b = np.flatnonzero(self.size == k), np.flatnonzero(other.size == k)
            dots, norms = self.matrix[k] @ other.matrix[k].T, np.outer(self.norm[a], other.norm[b])
            dots = np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)
            if dots.shape == out.shape:
                out = dots
            else:
                out[np.ix_(a, b)] = dots
        out[np.isnan(out)] = np.inf
        return out

    def cosines(self, at: np.ndarray, other: _Vectors, to: np.ndarray) -> np.ndarray:
        """cosine() of the pairs (at, to), summed in its order."""
        out = np.zeros(len(at))
        for k in self.matrix.keys() & other.matrix.keys():
            both = np.flatnonzero((self.size[at] == k) & (other.size[to] == k))
            a, b = at[both], to[both]
            norms = self.norm[a] * other.norm[b]
            dots = _in_order(other.matrix[k][other.place[b]], self.matrix[k][self.place[a]])
            out[both] = np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)
        return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, component by component, as dot() adds them up."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class _Best:
    """Of all rows so far those that can be among the k nearest of a block of queries."""

    def __init__(self, ids: list, vectors: _Vectors, k: int, kind: pa.DataType):
        self.vectors, self.k, self.reached = vectors, k, np.full(len(ids), -np.inf)
        self.query, self.id, self.score = np.zeros(0, np.int64), pa.array([], kind), np.zeros(0)
        self.places: dict = {}
        for n, x in enumerate(ids):
            self.places.setdefault(x, []).append(n)

    def add(self, ids: pa.Array, rows: _Vectors) -> None:
        found = self.vectors.products(rows)
        for n, x in enumerate(ids.to_pylist()):
            for q in self.places.get(x, ()):
                found[q, n] = -np.inf
        if found.shape[1] >= self.k and np.isneginf(self.reached).any():
            self.reached = np.maximum(self.reached, np.partition(found, -self.k, axis=1)[:, -self.k])
        at, to = np.nonzero((found >= self.reached[:, None] - MARGIN) & (found > -np.inf))
        if len(at):
            self.query = np.concatenate([self.query, at])
            self.id = pa.concat_arrays([self.id, ids.take(pa.array(to))])
            self.score = np.concatenate([self.score, self.vectors.cosines(at, rows, to)])
            self._prune()

    def _prune(self) -> None:
        # of rows of one score the first k by id are enough; of all, those within the margin of the k-th
        high = np.where(np.isnan(self.score), np.inf, self.score)
        order = np.lexsort((np.asarray(pc.rank(self.id, tiebreaker="dense")), -high, self.query))
        q, s = self.query[order], high[order]
        first = lambda new: np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        other = np.concatenate([[True], q[1:] != q[:-1]])
        kth = np.flatnonzero(first(other) == self.k - 1)
        self.reached[q[kth]] = np.maximum(self.reached[q[kth]], s[kth])
        kept = order[(first(other | np.concatenate([[True], s[1:] != s[:-1]])) < self.k) & (s >= self.reached[q] - MARGIN)]
        self.query, self.id, self.score = self.query[kept], self.id.take(pa.array(kept)), self.score[kept]


def nearest(rows: DataFrame, queries: DataFrame, k: int, most: int = MAX_QUERIES) -> DataFrame:
    """query_id, id, score, rank of the k nearest in the query's cell or cells; rows: cell, id, v; queries: cell,
    query_id, query_vector. No row is its own neighbour.

    A cell's rows are dealt to parts and its queries to blocks; each part meets each block once, so no side is sent
    whole to a task. There matrix products leave the few rows that can be among the k nearest, scored by cosine();
    every pair is compared, but only those leave the task.
    """
    rows = rows.filter(F.col("id").isNotNull()).withColumn("v", doubles(F.col("v")))
    queries = queries.filter(F.col("query_id").isNotNull()).withColumn("query_vector", doubles(F.col("query_vector")))
    plan = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts")).join(queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks")), "cell")
    plan = F.broadcast(plan)  # a row a cell, MAX_CELLS at most
    upto = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.col(x) - 1))
    left = rows.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("block", upto("blocks"))
    right = queries.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks"))).withColumn("part", upto("parts"))

    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"

    def met(own: pa.Table, asked: pa.Table) -> pa.Table:
        own, asked = own.combine_chunks(), asked.combine_chunks()
        made = []
        with np.errstate(all="ignore"):
            parts = [own.slice(s, ROWS_AT_ONCE) for s in range(0, own.num_rows, ROWS_AT_ONCE)]
            parts = [(x["id"].combine_chunks(), _Vectors(x["v"])) for x in parts]
            for s in range(0, asked.num_rows if parts else 0, QUERIES_AT_ONCE):
                block = asked.slice(s, QUERIES_AT_ONCE)
                best = _Best(block["query_id"].to_pylist(), _Vectors(block["query_vector"]), k, parts[0][0].type)
                for ids, vectors in parts:
                    best.add(ids, vectors)
                made.append(pa.table({"query_id": block["query_id"].take(pa.array(best.query)), "id": best.id, "score": best.score}))
        empty = pa.table({"query_id": asked["query_id"].slice(0, 0), "id": own["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *made])

    keys = ["cell", "part", "block"]
    near = left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "query_vector").groupBy(*keys)).applyInArrow(met, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MAX_QUERIES) -> DataFrame:
    """query_id, id, score, rank for a stated query set (query_id, query_vector), against all rows, `most` queries at
    a time."""
    cell = F.lit(0).alias("cell")
    return nearest(vectors.select(cell, F.col(id_col).alias("id"), F.col(vector_col).alias("v")), queries.select(cell, "query_id", "query_vector"), k, most)


def mean_vectors(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """by, mean: the element-wise mean of each group, partially summed before the shuffle."""
    each = vectors.select(by, F.posexplode(doubles(F.col(vector_col))).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return each.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def centroids(vectors: DataFrame, by: str, vector_col: str = "embedding") -> DataFrame:
    """Coarse cells from a column that already partitions the vectors (a label, a k-means cluster)."""
    return mean_vectors(vectors, by, vector_col).withColumnRenamed("mean", "centre")


def ivf_top_k(vectors: DataFrame, queries: DataFrame, cells: DataFrame, by: str, probes: int = 10, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """As batch_top_k(), looking only into the `probes` cells whose centres are nearest.
    Cells are coarse by design; over MAX_CELLS of them are an error."""
    if cells.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    near = queries.join(F.broadcast(cells), F.lit(True)).select("query_id", "query_vector", by, cosine(F.col("query_vector"), F.col("centre")).alias("c"))
    near = near.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("c"), by))).filter(F.col("at") <= probes)
    rows = vectors.select(F.col(by).alias("cell"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return nearest(rows, near.select(F.col(by).alias("cell"), "query_id", "query_vector"), k)
