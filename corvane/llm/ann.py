"""9. Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length, so the largest cosine is the smallest distance. A table hashes a
vector by k projections on Gaussian (2-stable) directions, floor((a.v + b) / w) each; k grows with the
logarithm of the number of vectors. A query visits the bucket it falls into and perturbed ones, moved by -1
or +1 in some projections, in order of estimated success: the sum of squared distances to the walls
crossed, for which the expected distances of a query's nearest, second nearest ... wall stand, so the order
is made once, by a heap, and holds for every query under its own order of walls.

Index and probes hold ids only. The queries of a block that visit a bucket are one list, which each row of
the bucket takes along; a row's lists from all tables are merged to the distinct queries that it is a
candidate of. Only then vectors come in: of each block of queries a candidate's vector is sent once, with
that list, and ranked by its exact cosine in double precision.

Probes are fitted to true neighbours: those of a bounded sample of queries among all vectors, found by
comparing that sample with every row. The fewest probes that find the asked share of them are taken.

Equal vectors are one class with its smallest ids, enough for any query's k nearest. A bucket with
more rows than SALT_ROWS is dealt to as many salts as it needs, and its queries go to each of them.
A query for which the tables give too few candidates is ranked against all rows, in blocks.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no
part, as queries or candidates; rows with a null vec_id take none; a query is compared with vectors of its own
length, so one without others has no rows; of rows that repeat a vec_id and vector one counts; an empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.llm.common import narrow, written

SAMPLE_QUERIES = 256
TABLES = 16
LEAST_PROJECTIONS = 4
#: So many probes of a table are tried when they are fitted; if they don't do, fewer projections are taken.
MOST_PROBES = 4096
#: Rows that a worker makes at once.
ROWS_AT_ONCE = 65_536
WIDTH = 2.0
RECALL = 0.93
SALT_ROWS = 1024
#: Queries whose vectors a task of the ranking holds.
QUERY_BLOCK = 2048
#: Where more than this share of a block's pairs are candidates they are multiplied as matrices.
DENSE = 0.02
SEED = 7


def perturbations(projections: int, most: int) -> np.ndarray:
    """Sets of walls to cross, likeliest first, as rows of 0 and 1 over the 2 * projections walls in order of
    their distance. Walls r and 2 * projections - 1 - r are those of one projection, so no set has both."""
    m = projections
    j = np.arange(1, 2 * m + 1, dtype=np.float64)
    up = j <= m
    # expected squared distance of the j-th nearest wall, in units of the width
    z = np.where(up, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    out, heap = [np.zeros(2 * m, np.uint64)], [(z[0], (0,))]
    while heap and len(out) < most:
        cost, walls = heapq.heappop(heap)
        last = walls[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost + z[last + 1], (*walls, last + 1)))
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*walls[:-1], last + 1)))
        if not {2 * m - 1 - w for w in walls} & set(walls):
            row = np.zeros(2 * m, np.uint64)
            row[list(walls)] = 1
            out.append(row)
    return np.array(out)


@dataclass(frozen=True)
class Hasher:
    directions: np.ndarray  # tables, projections, dimension; of a unit vector, projections of unit variance
    offsets: np.ndarray
    odd: np.ndarray  # tables, projections: what a cell's number is multiplied by
    sets: np.ndarray  # perturbations, as many as are visited

    @classmethod
    def drawn(cls, dimension: int, tables: int, projections: int, probes: int, seed: int = SEED) -> Hasher:
        rng = np.random.default_rng(seed)
        odd = rng.integers(0, 1 << 62, (tables, projections), np.uint64) * np.uint64(2) + np.uint64(1)
        return cls(rng.normal(size=(tables, projections, dimension)), rng.uniform(0, WIDTH, size=(tables, projections)), odd, perturbations(projections, probes))

    def visiting(self, probes: int) -> Hasher:
        return Hasher(self.directions, self.offsets, self.odd, self.sets[:probes])

    def projected(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.directions[table].T + self.offsets[table]) / WIDTH

    def sums(self, cells: np.ndarray, table: int) -> np.ndarray:
        return (cells.astype(np.int64).view(np.uint64) * self.odd[table]).sum(axis=1, dtype=np.uint64)

    @staticmethod
    def key(sums: np.ndarray, table: int) -> np.ndarray:
        """A bucket's key: a 64-bit digest of its cells and table. Two buckets of one key only share candidates."""
        x = sums + np.uint64(table * 0x9E3779B97F4A7C15 % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    def keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        return self.key(self.sums(np.floor(self.projected(unit, table)), table), table)

    def probe_keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Keys of the buckets to visit, likeliest first: one row a query."""
        at = self.projected(unit, table)
        cells = np.floor(at)
        inside = at - cells
        order = np.argsort(np.concatenate((inside, 1 - inside), axis=1), axis=1, kind="stable")
        step = np.concatenate((-self.odd[table].view(np.int64), self.odd[table].view(np.int64))).view(np.uint64)
        return self.key(self.sums(cells, table)[:, None] + step[order] @ self.sets.T, table)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def projections_for(n: int) -> int:
    return max(LEAST_PROJECTIONS, round(np.log2(max(n, 2)) / 2))


def fitted(queries: np.ndarray, neighbours: np.ndarray, of: np.ndarray, tables: int = TABLES, projections: int = LEAST_PROJECTIONS, recall: float = RECALL) -> Hasher:
    """The hasher with the fewest probes that find the asked share of the neighbours; neighbours[i] is one of
    queries[of[i]]. Where MOST_PROBES don't find it, with one projection less, down to none left out."""
    while True:
        hasher = Hasher.drawn(queries.shape[1], tables, projections, MOST_PROBES)
        most = len(hasher.sets)
        place = np.full(len(of), most, np.int64)  # the first probe that finds a neighbour, in any table
        q, v = unit(queries), unit(neighbours)
        for t in range(tables):
            own = hasher.keys(v, t)
            for s in range(0, len(of), 512):
                found = hasher.probe_keys(q[of[s : s + 512]], t) == own[s : s + 512, None]
                place[s : s + 512] = np.minimum(place[s : s + 512], np.where(found.any(axis=1), found.argmax(axis=1), most))
        needed = int(np.sort(place)[max(0, int(np.ceil(recall * len(place))) - 1)]) if len(place) else most - 1
        if needed < most or projections == 1:
            return hasher.visiting(min(most, needed + 1))
        projections -= 1


def _type(vectors: DataFrame) -> str:
    """Single precision is kept as it is, anything else is made double; sums are double in any case."""
    kind = dict(vectors.dtypes)["embedding"]
    return kind if kind == "array<float>" else "array<double>"


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """class (its smallest id), vector, ids (its k + 1 smallest) of each distinct vector that takes part."""
    own = narrow(vectors, vec_id="vec_id:long", vector=f"embedding:{_type(vectors)}").filter("vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    least = own.distinct().withColumn("at", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    return least.groupBy("vector").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    return narrow(vectors, vec_id="vec_id:long", vector=f"embedding:{_type(vectors)}").filter(f"vec_id % {every} = 0").distinct()


RANKED = "query long, class long, score double"


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def _keyed(hasher: Hasher, probes: bool):
    """(key, id) of index rows, or of queries for each bucket that they visit, from (id, vector)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROWS_AT_ONCE // len(hasher.sets)) if probes else ROWS_AT_ONCE
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                u, ids = unit(_vectors(part.column(1))), np.asarray(part.column(0))
                for t in range(len(hasher.directions)):
                    keys = hasher.probe_keys(u, t) if probes else hasher.keys(u, t)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, keys.shape[1]))], names=["key", "id"])

    return run


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its `keep` nearest distinct classes."""
    q, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (c[1:] != c[:-1])))  # one pair has one score, so copies stand together
    q, c, s = q[new], c[new], s[new]
    first = np.concatenate(([True], q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return q[rank < keep], c[rank < keep], s[rank < keep]


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def candidates(index: DataFrame, probes: DataFrame, blocks: int) -> DataFrame:
    """block, class, queries: the distinct queries of each block that share a bucket with a class, from
    (key, id) on both sides. Large buckets are dealt."""
    sizes = index.groupBy("key").count().filter(F.col("count") > SALT_ROWS).select("key", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = index.join(sizes, "key", "left").select("key", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("id").alias("class"))
    lists = probes.groupBy("key", block_of("id", blocks).alias("block")).agg(F.collect_list("id").alias("queries"))
    right = lists.join(sizes, "key", "left").select("key", "block", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "queries")
    return left.join(right, ["key", "salt"]).groupBy("block", "class").agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries"))


def _scored(keep: int):
    """From rows (block, salt, side, id, vector, queries), sorted by the first three: side 0 are a block's
    queries, side 1 its candidates with the queries that ask for each. The nearest of each query."""
    dense = DENSE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, vectors, found, held = None, [], [], [], 0

        def out():
            q, c, s = _best(found, keep)
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["query", "class", "score"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)) for k in (0, 1, 2)], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                ids, v = np.asarray(part.column(3)), _vectors(part.column(4))
                if (bucket := tuple(keys[a, :2])) != now:
                    now, names, vectors = bucket, [], []
                if keys[a, 2] == 0:
                    names.append(ids)
                    vectors.append(v)
                    continue
                q_ids, q = np.concatenate(names), np.concatenate(vectors)
                order = np.argsort(q_ids)
                q_ids, q = q_ids[order], q[order]
                norm = np.sqrt((q * q).sum(axis=1))
                lists = part.column(5)
                of = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
                at = np.searchsorted(q_ids, np.asarray(lists.flatten()))
                own = np.sqrt((v * v).sum(axis=1))
                if len(of) > dense * len(ids) * len(q):  # most pairs are asked for: all products at once, then the nearest of those asked for
                    near = np.full((len(q), len(ids)), -np.inf)
                    near[at, of] = (q @ v.T / own)[at, of]
                    k = min(keep, len(ids))
                    # whatever rounding may put among the k nearest, ties with the last one included
                    rounding = 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps * norm
                    least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] - rounding
                    at, of = np.nonzero((near >= least[:, None]) & np.isfinite(near))
                for s in range(0, len(of), ROWS_AT_ONCE):
                    x, y = of[s : s + ROWS_AT_ONCE], at[s : s + ROWS_AT_ONCE]
                    # the exact measure, summed in one order whatever the block
                    score = (q[y] * v[x]).sum(axis=1) / (norm[y] * own[x])
                    found.append((q_ids[y], ids[x], score))
                    held += len(x)
                    if held > 400_000:
                        found[:] = [_best(found, keep)]
                        held = len(found[0][0])
            if held > 200_000:
                yield out()
                found, held = [], 0
        if found:
            yield out()

    return run


def ranked(asked: DataFrame, classes: DataFrame, searched: DataFrame, blocks: int, keep: int) -> DataFrame:
    """query, class, score of the nearest by exact cosine. asked: candidates(); classes: (class, vector);
    searched: (id, vector) of the queries."""
    salts = max(1, -(-int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    right = asked.join(classes.select("class", "vector"), "class").select("block", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("side"), F.col("class").alias("id"), "vector", "queries")
    none = F.array().cast("array<long>")
    left = searched.select(block_of("id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), "id", "vector", none.alias("queries"))
    both = left.unionByName(right).repartition("block", "salt").sortWithinPartitions("block", "salt", "side")
    return both.mapInArrow(_scored(keep), RANKED)


def _of_sample(sample: np.ndarray, names: np.ndarray, keep: int):
    """From (class, vector) rows: the nearest to each of a few queries, in each task, with their vectors."""

    def run(batches):
        u, found, vectors = unit(sample), [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = np.asarray(batch.column(0)), _vectors(batch.column(1))
            near = u @ unit(v).T
            near[names[:, None] == ids[None, :]] = -np.inf
            k = min(keep, len(ids))
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            found.append((np.repeat(np.arange(len(u)), k), ids[best].reshape(-1), np.take_along_axis(near, best, 1).reshape(-1)))
            vectors |= {int(ids[x]): v[x] for x in np.unique(best)}
            q, c, s = _best(found, keep)
            found = [(q, c, s)]
            kept = set(c.tolist())
            vectors = {i: x for i, x in vectors.items() if i in kept}
        if found:
            q, c, s = found[0]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s), pa.array([vectors[int(x)].tolist() for x in c], kind)], names=["query", "class", "score", "vector"])

    return run


def true_neighbours(classes: DataFrame, names: np.ndarray, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest vectors of each sample query among all, and the query of each: 256 * k rows reach the driver."""
    found = classes.select("class", "vector").mapInArrow(_of_sample(sample, names, k), "query long, class long, score double, vector array<double>")
    at = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "class"))
    near = found.withColumn("at", at).filter((F.col("at") <= k) & (F.col("score") > -2)).select("query", "vector").collect()
    dimension = sample.shape[1]
    return np.array([r["vector"] for r in near], np.float64).reshape(-1, dimension), np.array([r["query"] for r in near], np.int64)


def _nearest(found: DataFrame, keep: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "class")
    return found.groupBy("query", "class").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep).drop("at")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = TABLES, projections: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k nearest."""
    spark = vectors.sparkSession
    classes = written(spark, classes_of(vectors, k), "ann-classes")
    asked = written(spark, queries_of(vectors, every).join(classes, "vector").select("vec_id", "class", F.size("vector").alias("length")), "ann-asked")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in sorted(r[0] for r in asked.select("length").distinct().collect()):
        own, named = classes.filter(F.size("vector") == length), asked.filter(F.col("length") == length).drop("length")
        out = out.unionByName(_nearest_of(own, named, k, tables, projections, recall))
    return out


def _nearest_of(classes: DataFrame, named: DataFrame, k: int, tables: int, projections: int | None, recall: float) -> DataFrame:
    """nearest() among classes of one length, for the queries named (vec_id, class)."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.select("class", "vector").orderBy(F.xxhash64("class", F.lit(SEED)), "class").limit(SAMPLE_QUERIES).collect()
    names, own = np.array([r["class"] for r in sample], np.int64), np.array([r["vector"] for r in sample], np.float64)
    hasher = fitted(own, *true_neighbours(classes, names, own, k), tables, projections or projections_for(total), recall)
    # a query is searched once for each distinct vector, under the name of its class
    searched = written(spark, classes.join(named.select("class").distinct(), "class", "left_semi").select(F.col("class").alias("id"), "vector"), "ann-queries")
    index = classes.select(F.col("class").alias("id"), "vector").mapInArrow(_keyed(hasher, False), "key long, id long")
    probes = searched.mapInArrow(_keyed(hasher, True), "key long, id long")
    keep = k + 1
    blocks = max(1, -(-searched.count() // QUERY_BLOCK))
    found = written(spark, _nearest(ranked(candidates(index, probes, blocks), classes, searched, blocks, keep), keep), "ann-found")
    enough = min(keep, total)
    short = searched.join(found.groupBy("query").count().filter(F.col("count") >= enough).select(F.col("query").alias("id")), "id", "left_anti")
    short = written(spark, short, "ann-short")
    if n := short.count():
        # each part of the rows meets each block of these queries once
        parts = max(1, total // SALT_ROWS)
        blocks = -(-n // QUERY_BLOCK)
        upto = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
        mine = short.select(block_of("id", blocks).alias("block"), upto(parts).alias("part"), F.col("id").alias("query"))
        lists = mine.groupBy("block", "part").agg(F.collect_list("query").alias("queries"))
        rows = classes.select("class", "vector", F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int").alias("part"))
        right = rows.join(lists, "part").select("block", F.col("part").alias("salt"), F.lit(1).alias("side"), F.col("class").alias("id"), "vector", "queries")
        left = short.select(block_of("id", blocks).alias("block"), upto(parts).alias("salt"), F.lit(0).alias("side"), "id", "vector", F.array().cast("array<long>").alias("queries"))
        both = left.unionByName(right).repartition("block", "salt").sortWithinPartitions("block", "salt", "side")
        found = _nearest(found.unionByName(both.mapInArrow(_scored(keep), RANKED)), keep)
    listed = found.join(classes.select("class", "ids"), "class").select(F.col("query").alias("class"), "score", F.explode("ids").alias("vec_id"))
    pairs = named.withColumnRenamed("vec_id", "query_id").join(listed, "class").filter("vec_id <> query_id")
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", at).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_ranked(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> tuple[int, float]:
    """Projections of a table, and the mean share of all distinct vectors that a query is compared with."""
    spark = vectors.sparkSession
    classes = written(spark, classes_of(vectors, k), "ann-classes")
    total = classes.count()
    sample = classes.select("class", "vector").orderBy(F.xxhash64("class", F.lit(SEED)), "class").limit(SAMPLE_QUERIES).collect()
    names, own = np.array([r["class"] for r in sample], np.int64), np.array([r["vector"] for r in sample], np.float64)
    hasher = fitted(own, *true_neighbours(classes, names, own, k), TABLES, projections_for(total), recall)
    searched = classes.filter(f"class % {every} = 0").select(F.col("class").alias("id"), "vector")
    index = classes.select(F.col("class").alias("id"), "vector").mapInArrow(_keyed(hasher, False), "key long, id long")
    asked = candidates(index, searched.mapInArrow(_keyed(hasher, True), "key long, id long"), max(1, -(-searched.count() // QUERY_BLOCK)))
    pairs = asked.agg(F.sum(F.size("queries"))).first()[0] or 0
    return hasher.directions.shape[1], pairs / total / max(1, searched.count())


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
