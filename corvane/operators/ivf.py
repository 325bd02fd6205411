"""Coarse cells that are trained: k-means by cosine, and vectors stored by cell.

Seeding is parallel: in each of a few rounds every vector is drawn with a probability proportional to its
distance from the seeds so far (by a digest of its id, so a retried task draws the same), and the drawn ones,
some times as many as cells are wanted, are weighted by the vectors nearest to them and clustered among
themselves. A round of training sums the unit vectors of each cell within a task, then over tasks; what
reaches the driver is one sum a cell. A cell that lost all its vectors takes a vector far from its own centre.

stored() writes each vector to its cell's folder, in parts of about LIST_ROWS rows, so a large cell is several
files. probed() reads the folders of the cells that any query asks for, and no others.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component are in no cell, nor are
those of another length than most; ties go to the smaller cell; repeated rows are stored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.vectors import cosine
from corvane.operators.vector import MAX_CELLS, nearest
from corvane.sources.shared import written

SEED_ROUNDS, OVERSAMPLING, ROUNDS = 4, 2, 10
LIST_ROWS = 100_000
SEED = 11


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector (doubles) of the vectors that can be in a cell."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.filter("size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    most = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return own.filter(F.size("vector") == (most[0]["n"] if most else 0))


def _units(column: pa.Array) -> np.ndarray:
    v = np.asarray(column.flatten()).reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of the largest cosine, and one minus that."""
    near = units @ centres.T
    at = near.argmax(axis=1)
    return at, np.maximum(1 - near[np.arange(len(at)), at], 0)


def _each(own: DataFrame, centres: np.ndarray, schema: str, made) -> DataFrame:
    sent = own.sparkSession.sparkContext.broadcast(centres)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                units = _units(part.column(1))
                yield made(part, units, *_nearest(units, sent.value))

    return own.select("id", "vector").mapInArrow(run, schema)


def assigned(own: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, vector, cell, away of each usable vector."""
    made = lambda part, _, cell, away: pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["id", "vector", "cell", "away"])
    kind = dict(own.dtypes)["id"]
    return _each(own, centres, f"id {kind}, vector array<double>, cell int, away double", made)


def _sums(own: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum of the unit vectors of each cell, its vectors, and the mean distance: partial sums in each task, summed
    by cell, one row a cell to the driver."""
    cells, width = centres.shape
    sent = own.sparkSession.sparkContext.broadcast(centres)

    def partial(batches) -> Iterator[pa.RecordBatch]:
        total, n, away = np.zeros((cells, width)), np.zeros(cells, np.int64), np.zeros(cells)
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                units = _units(batch.column(1).slice(s, 4096))
                if len(units):
                    at, d = _nearest(units, sent.value)
                    np.add.at(total, at, units)
                    n += np.bincount(at, minlength=cells)
                    away += np.bincount(at, d, cells)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[k] for k in used], pa.list_(pa.float64())), pa.array(n[used]), pa.array(away[used])], names=["cell", "total", "n", "away"])

    def summed(batches) -> Iterator[pa.RecordBatch]:
        now: dict[int, list] = {}
        for batch in batches:
            for cell, total, n, away in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = now.setdefault(cell, [np.zeros(width), 0, 0.0])
                held[0] += total
                held[1] += n
                held[2] += away
        yield pa.RecordBatch.from_arrays([pa.array([*now], pa.int32()), pa.array([x[0] for x in now.values()], pa.list_(pa.float64())), pa.array([x[1] for x in now.values()], pa.int64()), pa.array([x[2] for x in now.values()], pa.float64())], names=["cell", "total", "n", "away"])

    schema = "cell int, total array<double>, n long, away double"
    # sorted, so that a cell's partial sums add up in one order
    rows = own.select("id", "vector").mapInArrow(partial, schema).repartition("cell").sortWithinPartitions("cell", "total").mapInArrow(summed, schema).collect()
    total, n = np.zeros((cells, width)), np.zeros(cells, np.int64)
    for r in rows:
        total[r["cell"]], n[r["cell"]] = r["total"], r["n"]
    return total, n, sum(r["away"] for r in rows) / max(1, int(n.sum()))


def _centred(total: np.ndarray, before: np.ndarray) -> np.ndarray:
    norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
    return np.where(norm > 0, total / np.where(norm > 0, norm, 1), before)


def seeds(own: DataFrame, cells: int, rounds: int = SEED_ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit vectors to begin with, at most `cells`."""
    draw = lambda k: F.xxhash64("id", F.lit(seed + k)).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))
    first = own.orderBy(draw(0), "id").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    unit = lambda rows: np.array([v / np.linalg.norm(v) for v in (np.array(r["vector"]) for r in rows)])
    found = unit(first)
    for k in range(1, rounds + 1):
        away = assigned(own, found)
        total = away.agg(F.sum("away")).first()[0]
        if not total:
            break
        wanted = OVERSAMPLING * cells
        drawn = away.filter(draw(k) < wanted * F.col("away") / F.lit(total)).orderBy("id").limit(4 * wanted).collect()
        found = np.unique(np.concatenate([found, unit(drawn)]), axis=0) if drawn else found
    if len(found) <= cells:
        return found
    _, weight, _ = _sums(own, found)
    # weighted k-means++ and a few rounds among the drawn ones, of which there are at most a few times `cells`
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    near = 1 - found @ found[chosen[0]]
    while len(chosen) < cells:
        p = np.maximum(near, 0) * weight
        chosen.append(int(rng.choice(len(found), p=p / p.sum())) if p.sum() > 0 else next(k for k in range(len(found)) if k not in set(chosen)))
        near = np.minimum(near, 1 - found @ found[chosen[-1]])
    centres = found[chosen]
    for _ in range(5):
        at, _ = _nearest(found, centres)
        total = np.zeros_like(centres)
        np.add.at(total, at, found * weight[:, None])
        centres = _centred(total, centres)
    return centres


def trained(vectors: DataFrame, cells: int, rounds: int = ROUNDS, start: np.ndarray | None = None, id_col: str = "vec_id", vector_col: str = "embedding", least_gain: float = 1e-4) -> np.ndarray:
    """Unit centres of at most `cells` cells. start: centres to begin with, else seeds()."""
    if not 0 < cells <= MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    own = written(vectors.sparkSession, usable(vectors, id_col, vector_col), "ivf-vectors")
    centres = seeds(own, cells) if start is None else start / np.linalg.norm(start, axis=1, keepdims=True)
    before = np.inf
    for _ in range(rounds if len(centres) else 0):
        total, n, away = _sums(own, centres)
        centres = _centred(total, centres)
        if start is None and len(empty := np.flatnonzero(n == 0)):
            far = assigned(own, centres).orderBy(F.desc("away"), "id").limit(len(empty)).collect()
            for k, r in zip(empty, far, strict=False):
                centres[k] = np.array(r["vector"]) / np.linalg.norm(r["vector"])
        elif before - away < least_gain * away:
            break
        before = away
    return centres


def stored(vectors: DataFrame, centres: np.ndarray, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Writes the vectors by cell under path/cells, and the centres under path/centres."""
    spark = vectors.sparkSession
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    rows = written(spark, assigned(usable(vectors, id_col, vector_col), centres), "ivf-assigned")
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("parts"))
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # a row a cell, MAX_CELLS at most
    dealt.select("cell", "part", "id", "vector").repartition("cell", "part").drop("part").write.partitionBy("cell").parquet(f"{path}/cells")


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int = 10, k: int = 5) -> DataFrame:
    """query_id, id, score, rank: the k nearest of each query (query_id, query_vector) in its `probes` nearest cells."""
    centres = spark.read.parquet(f"{path}/centres")
    near = queries.join(F.broadcast(centres), F.lit(True)).select("query_id", "query_vector", "cell", cosine(F.col("query_vector"), F.col("centre")).alias("c"))
    near = near.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("c"), "cell"))).filter(F.col("at") <= probes).select("query_id", "query_vector", "cell")
    near = written(spark, near, "ivf-probes")
    asked = [r["cell"] for r in near.select("cell").distinct().collect()]  # at most MAX_CELLS
    rows = spark.read.parquet(f"{path}/cells").filter(F.col("cell").isin(asked))
    return nearest(rows.select("cell", "id", F.col("vector").alias("v")), near, k)


def share_read(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> float:
    """The mean share of all stored vectors that a query is compared with."""
    centres = spark.read.parquet(f"{path}/centres")
    near = queries.join(F.broadcast(centres), F.lit(True)).select("query_id", "cell", cosine(F.col("query_vector"), F.col("centre")).alias("c"))
    near = near.withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("c"), "cell"))).filter(F.col("at") <= probes)
    sizes = spark.read.parquet(f"{path}/cells").groupBy("cell").count()
    each = near.join(sizes, "cell", "left").groupBy("query_id").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    return each.agg(F.avg("n")).first()[0] / sizes.agg(F.sum("count")).first()[0]
