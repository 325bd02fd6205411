"""13. Hard negatives by a Voronoi-partitioned distributed kNN join.

The largest inner product becomes the smallest distance by one more coordinate: a row x becomes
(x, sqrt(M^2 - |x|^2)), M being the largest norm, an anchor a becomes (a, 0), and then
|a' - x'|^2 = |a|^2 + M^2 - 2 a.x. Rows and anchors go to the nearest of PIVOTS pivots at most, a bounded sample; an
anchor cell knows its radius U, the largest distance of an anchor to its pivot.

1. Home join: each anchor meets the rows of its own cell. Its last wanted score there bounds how far its
   true positives can lie, and the cell's bound T is that of its anchors.
2. Positives: a row goes to the anchor groups that it might serve, those with a cell where its distance
   to the pivot is at most U + T (triangle inequality), and is joined there exactly.
3. Negatives: scores must lie between 80 and 100 hundredths of a positive's, so a cell's anchors ask for a
   ring: distances to the pivot between R - U and T + U, R being the smallest distance allowed.

A group holds the anchors of neighbouring cells, GROUP at most; larger cells are dealt to several groups.
A group's rows are dealt to salts, each of which sees all anchors of the group; the best of each salt are ranked
once more. Equal vectors of one label are one class with its smallest ids, enough for any anchor.

Bounds prune where vectors form clusters. Where they are spread evenly over many dimensions, all rows may
serve every group; then each anchor is compared with all rows, in matrix blocks.

Defined results: rows with a null id, label or vector, an empty vector or a null or non-finite component take no
part, nor do vectors too long for 64-bit products (quantised norms over 2^30). Rows that repeat a vec_id are one: that of
the smallest label, then vector. Anchors only meet vectors of their own length. Positives are rows of
another vec_id. No anchor, no rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.llm.common import joined_by_group, narrow, released, written

#: Pivots are twice the square root of the number of anchors, within these limits.
PIVOTS = (64, 1024)
GROUP = 2048
POSITIVES, NEGATIVES = 5, 5
ANCHORS, RELABELLED = 100, 7
SCALE, LABELS = 256, 10
LOW, HIGH = 80, 100
SEED = 13
#: Rows that are compared with a group at once.
ROWS = 1024
EXACT = 1 << 52  # products up to this are exact in doubles

FOUND = "anchor long, slot long, score long, vec_id long"


def quantised(vectors: DataFrame, relabelled: int = RELABELLED) -> DataFrame:
    """vec_id, label, vector (integers) of the rows that take part, one a vec_id."""
    own = narrow(vectors, vec_id="vec_id:long", label="label:long", vector="embedding:array<double>")
    own = own.filter("vec_id is not null and label is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    own = own.filter(f"aggregate(vector, 0D, (s, x) -> s + {SCALE * SCALE}D * x * x) < {2.0**60}D")
    label = F.when(F.col("vec_id") % relabelled == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    own = own.select("vec_id", label.alias("label"), F.transform("vector", lambda x: F.floor(SCALE * x).cast("int")).alias("vector"))
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """id (a number), label, vector, ids (the `keep` smallest, in order) of each label and vector."""
    salts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a vector that many rows share is cut to its smallest ids in parts first
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
    few = rows.withColumn("salt", salt).withColumn("at", F.row_number().over(W.partitionBy("label", "vector", "salt").orderBy("vec_id"))).filter(F.col("at") <= keep)
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep)
    return few.groupBy("label", "vector").agg(ids.alias("ids")).select(F.monotonically_increasing_id().alias("id"), "label", "vector", "ids")


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(kind)


class Cells:
    """The pivots, and what is known of the anchors of each cell: radius, outer and inner bound, groups."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most  # most: M^2
        self.spare = np.sqrt(np.maximum(most - (pivots * pivots).sum(axis=1), 0))
        n = len(pivots)
        self.radius, self.outer, self.inner = np.zeros(n), np.full(n, -np.inf), np.zeros(n)
        self.first, self.parts = np.zeros(n, np.int64), np.zeros(n, np.int64)  # groups of a cell: so many from the first on

    def distances(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        norms = (vectors * vectors).sum(axis=1)
        product = vectors @ self.pivots.T
        if anchors:
            return np.sqrt(np.maximum(norms[:, None] + self.most - 2 * product, 0))
        product += np.sqrt(np.maximum(self.most - norms, 0))[:, None] * self.spare
        return np.sqrt(np.maximum(2 * self.most - 2 * product, 0))

    def grouped(self, counts: dict[int, int], size: int) -> int:
        """Deals cells with anchors to groups: neighbours together, a large cell to several. Returns how many groups."""
        order, left = [], [*counts]
        while left:
            gap = ((self.pivots[left] - self.pivots[order[-1] if order else left[0]]) ** 2).sum(axis=1)
            order.append(left.pop(int(gap.argmin())))
        group, held = -1, size
        for cell in order:
            n = counts[cell]
            if held + n > size:
                group, held = group + 1, 0
            self.first[cell], self.parts[cell] = group, max(1, -(-n // size))
            group, held = group + int(self.parts[cell]) - 1, held + n if n <= size else size
        return group + 1


def _placed(cells: Cells):
    """From (id, label, vector) of anchors: their cell, its distance and their group."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = cells.distances(_matrix(batch.column(2)), True)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=["id", "label", "vector", "cell", "away"])

    return run


def _routed(cells: Cells, home: bool):
    """From (id, label, vector, ids) of rows: one for each group that the row might serve."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        # three distances, each the root of a difference of sums that are up to 4 * M^2
        slack = 1e-6 + 6 * np.sqrt(np.finfo(np.float64).eps * (cells.pivots.shape[1] + 8) * cells.most)
        live = np.flatnonzero(cells.parts)
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                d = cells.distances(_matrix(batch.column(2)), False)
                if home:
                    cell = d.argmin(axis=1)
                    serves = cell[:, None] == live
                else:
                    own = d[:, live]
                    serves = (own <= (cells.radius + cells.outer + slack)[live]) & (own >= (cells.inner - cells.radius - slack)[live])
                y, x = np.nonzero(serves)
                parts = cells.parts[live][x]
                y, base = np.repeat(y, parts), np.repeat(cells.first[live][x], parts)
                group = base + np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
                pairs = np.unique(np.stack([y, group], axis=1), axis=0)
                rows = batch.take(pa.array(pairs[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), *rows.columns], names=["group", "id", "label", "vector", "ids"])

    return run


class Best:
    """The `keep` first rows of each slot: by score, largest first, then by vec_id."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.rows = keep, np.zeros((3, 0), np.int64)  # slot, score, vec_id
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        rows = np.concatenate((self.rows, np.stack([slot, score, vec_id])), axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        rank = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.concatenate((first, [rows.shape[1]]))))
        self.rows = rows[:, rank < self.keep]
        last = rows[:, rank == self.keep - 1]
        self.least[last[0]] = last[1]


def _joined(keep: int, same: bool, exact: bool):
    """From rows (group, salt, side, id, label, vector, limits, ids), sorted by the first three: side 0 are a group's
    anchors, side 1 its rows. The best of each anchor and slot within this salt: with `same`, rows of the anchor's
    label; else rows of other labels with scores within the limit's range, for each of the anchor's limits."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, parts, state = None, [], None
        kind = np.float64 if exact else np.int64

        def out() -> Iterator[pa.RecordBatch]:
            if state:
                ids, owner, limit, best = state[0], state[3], state[4], state[6]
                slot, score, vec_id = best.rows
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[slot]]), pa.array(limit[slot]), pa.array(score), pa.array(vec_id)], names=["anchor", "slot", "score", "vec_id"])

        def begun():
            ids = np.concatenate([np.asarray(p.column(3)) for p in parts])
            labels = np.concatenate([np.asarray(p.column(4)) for p in parts])
            vectors = np.concatenate([_matrix(p.column(5), kind) for p in parts])
            counts = np.concatenate([np.diff(np.asarray(p.column(6).offsets)) for p in parts])
            limit = np.concatenate([np.asarray(p.column(6).flatten()) for p in parts])
            owner = np.repeat(np.arange(len(ids)), counts)
            first = np.cumsum(counts) - counts  # each anchor's slots
            return ids, labels, vectors, owner, limit, (first, counts), Best(len(owner), keep)

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1, 2)], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (group := tuple(keys[a, :2])) != now:
                    yield from out()
                    now, parts, state = group, [], None
                if keys[a, 2] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                state = state or begun()
                _, labels, vectors, owner, limit, (first, counts), best = state
                for s in range(0, part.num_rows, ROWS):
                    rows = part.slice(s, ROWS)
                    scores = vectors @ _matrix(rows.column(5), kind).T
                    alike = labels[:, None] == np.asarray(rows.column(4))
                    if same:
                        y, x = np.nonzero(alike & (scores >= best.least[:, None]))
                        slot, score = y, scores[y, x].astype(np.int64)
                    else:
                        # 80 * limit <= 100 * score <= 100 * limit
                        low = np.maximum(-(-LOW * limit // HIGH), best.least)
                        lowest, highest = np.full(len(labels), np.inf), np.full(len(labels), -np.inf)
                        np.minimum.at(lowest, owner, low)
                        np.maximum.at(highest, owner, limit)
                        y, x = np.nonzero(~alike & (scores >= lowest[:, None]) & (scores <= highest[:, None]))
                        score = scores[y, x].astype(np.int64)
                        n = counts[y]
                        slot = np.repeat(first[y], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        x, score = np.repeat(x, n), np.repeat(score, n)
                        fits = (score >= low[slot]) & (score <= limit[slot])
                        slot, x, score = slot[fits], x[fits], score[fits]
                    if len(slot):
                        lists = rows.column(7)
                        offsets = np.asarray(lists.offsets)
                        n = (offsets[1:] - offsets[:-1])[x]
                        at = np.repeat(offsets[x] - offsets[0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        best.add(np.repeat(slot, n), np.repeat(score, n), np.asarray(lists.flatten())[at])
        yield from out()

    return run


def _best(found: DataFrame, keep: int) -> DataFrame:
    at = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("at", at).filter(F.col("at") <= keep)


class Search:
    """One length of vectors: classes, the anchors among them in cells and groups, and joins between both."""

    def __init__(self, classes: DataFrame, anchors: DataFrame, group: int = GROUP):
        self.spark, self.classes = classes.sparkSession, classes
        square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        self.most = int(classes.agg(F.max(square)).first()[0])
        n = anchors.count()
        wanted = min(max(PIVOTS[0], round(2 * n**0.5)), PIVOTS[1])
        sample = classes.select("vector").orderBy(F.xxhash64("vector", F.lit(SEED)), "vector").limit(wanted).collect()
        self.cells = Cells(np.array([r["vector"] for r in sample], np.float64), float(self.most))
        placed = anchors.select("id", "label", "vector").mapInArrow(_placed(self.cells), "id long, label long, vector array<int>, cell long, away double")
        placed = written(self.spark, placed, "negatives-anchors")
        counts = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()}
        for cell, r in counts.items():
            self.cells.radius[cell] = r["away"]
        self.groups = self.cells.grouped({c: r["n"] for c, r in sorted(counts.items())}, group)
        c = self.cells
        pairs = self.spark.createDataFrame([(int(k), int(c.first[k]), int(c.parts[k])) for k in counts], "cell long, first long, parts long")
        self.placed = placed.join(F.broadcast(pairs), "cell").withColumn("group", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("first", "parts")
        self.salts = max(1, -(-4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.groups))

    def join(self, keep: int, same: bool, home: bool, limits: DataFrame | None = None) -> DataFrame:
        """FOUND of the anchors, under the cells' bounds as they stand. limits: (id, limits) of those that are asked for."""
        salt = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(self.salts)).cast("int")
        own = self.placed.withColumn("limits", F.array(F.lit(0).cast("long"))) if limits is None else self.placed.join(limits, "id")
        none = F.array().cast("array<long>")
        left = own.select("group", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))).alias("salt"), F.lit(0).alias("side"), "id", "label", "vector", "limits", none.alias("ids"))
        routed = self.classes.select("id", "label", "vector", "ids").mapInArrow(_routed(self.cells, home), "group long, id long, label long, vector array<int>, ids array<long>")
        right = routed.select("group", salt("id").alias("salt"), F.lit(1).alias("side"), "id", "label", "vector", none.alias("limits"), "ids")
        both = left.unionByName(right).repartition("group", "salt").sortWithinPartitions("group", "salt", "side")
        return _best(both.mapInArrow(_joined(keep, same, self.most < EXACT), FOUND), keep)

    def bounded(self, bounds: DataFrame) -> None:
        """Sets the cells' bounds from (id, low, high): the scores between which each anchor looks (null: any)."""
        square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        away = lambda score: F.when(F.col(score).isNotNull(), F.sqrt(F.greatest(square + F.lit(self.most) - 2 * F.col(score), F.lit(0)).cast("double")))
        each = self.placed.join(bounds, "id").select("cell", F.coalesce(away("low"), F.lit(float("inf"))).alias("outer"), F.coalesce(away("high"), F.lit(0.0)).alias("inner"))
        self.cells.outer[:], self.cells.inner[:] = -np.inf, 0
        for r in each.groupBy("cell").agg(F.max("outer").alias("outer"), F.min("inner").alias("inner")).collect():
            self.cells.outer[r["cell"]], self.cells.inner[r["cell"]] = r["outer"], r["inner"]

    def positives(self, keep: int) -> DataFrame:
        """FOUND with at: the `keep` best of each anchor's label, itself included."""
        near = self.join(keep, True, True).filter(F.col("at") == keep).select(F.col("anchor").alias("id"), F.col("score").alias("low"))
        all_of = self.placed.select("id").join(near, "id", "left").withColumn("high", F.lit(None).cast("long"))
        self.bounded(all_of)
        return written(self.spark, self.join(keep, True, False), "negatives-positives")

    def negatives(self, positives: DataFrame, keep: int) -> DataFrame:
        """FOUND with at, slot being the positive's score: the `keep` best that may go with it."""
        limits = positives.filter("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_set("score")).alias("limits"))
        limits = written(self.spark, limits, "negatives-limits")
        low = F.ceil(F.element_at("limits", 1) * F.lit(LOW) / F.lit(HIGH)).cast("long") - 1
        self.bounded(limits.select("id", low.alias("low"), F.element_at("limits", -1).alias("high")))
        out = written(self.spark, self.join(keep, False, False, limits), "negatives-found")
        released(self.spark, limits)
        return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, every: int = ANCHORS, relabelled: int = RELABELLED, positives: int = POSITIVES, negatives: int = NEGATIVES, group: int = GROUP) -> DataFrame:
    """RESULT: for each row whose vec_id is divisible by `every` and each of its positives the best negatives."""
    spark = vectors.sparkSession
    rows = written(spark, quantised(vectors, relabelled), "negatives-rows")
    classes = written(spark, classes_of(rows, max(positives + 1, negatives)), "negatives-classes")
    named = rows.filter(f"vec_id % {every} = 0").join(classes, ["label", "vector"]).select("vec_id", "id", F.size("vector").alias("length"))
    named = written(spark, named, "negatives-named")
    out = spark.createDataFrame([], RESULT)
    for length in sorted(r[0] for r in named.select("length").distinct().collect()):
        mine = named.filter(F.col("length") == length).select("vec_id", F.col("id").alias("anchor"))
        of_length = classes.filter(F.size("vector") == length)
        search = Search(of_length, of_length.join(mine.select(F.col("anchor").alias("id")).distinct(), "id", "left_semi"), group)
        near = search.positives(positives + 1)
        far = search.negatives(near, negatives)
        anchors, total = mine.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), mine.count()
        lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "score", "vec_id"))).alias("near")).join(anchors, "anchor")
        each = joined_by_group(mine, lists, "anchor", total)
        others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, positives)
        each = each.select("anchor", F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p")).select("anchor", "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
        each = each.withColumn("key", F.struct("anchor", "positive_score")).drop("anchor")
        asked = far.groupBy("anchor", "slot").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("far")).join(anchors, "anchor")
        asked = asked.select(F.struct("anchor", F.col("slot").alias("positive_score")).alias("key"), "far", F.col("n"))
        full = joined_by_group(each, asked, "key", positives * total).select("anchor_id", "positive_id", "positive_score", F.explode("far").alias("f"))
        out = out.unionByName(full.select("anchor_id", "positive_id", F.col("f.at").cast("int").alias("rank"), F.col("f.vec_id").alias("negative_id"), "positive_score", F.col("f.score").alias("negative_score")))
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
far AS (SELECT near.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY near.anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank
        FROM near JOIN p ON p.anchor_id = near.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 5
"""
