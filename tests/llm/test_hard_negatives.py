"""Hard negatives against all pairs."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import hard_negatives as op

SCHEMA = "vec_id long, label long, embedding array<double>"


def brute(rows) -> Counter:
    own: dict[int, tuple] = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        own[i] = min(own.get(i, row), row)
    out = Counter()
    for a, (label, v) in own.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in own.items() if len(w) == len(v) and i != a)
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, i) for n, i, other in scored if other != label and 80 * -p <= 100 * -n <= 100 * -p]
            for rank, (n, i) in enumerate(fits[:5], 1):
                out[a, positive, rank, i, -p, -n] += 1
    return out


def found(df, **more) -> Counter:
    columns = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    return Counter(map(tuple, op.hard_negatives(df, **more).select(*columns).collect()))


def test_embeddings(spark, sf, duck):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r[0], r[1], [float(x) for x in r[2]]) for r in df.select("vec_id", "label", "embedding").collect()]
    got = Counter(map(tuple, op.op13_hard_negatives(spark, sf).collect()))
    assert got == brute(rows) and got
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert got == Counter(duck.execute(f"SELECT {columns} FROM ({op.OP13_SQL})").fetchall())


@pytest.mark.parametrize("group", [op.GROUP, 3])
def test_clusters_ties_and_odd_rows(spark, group):
    """Clusters, a vector that a third of the rows share, scores in common, other lengths, negative scores, nulls."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(0, 1500, 5):
        c = rng.choice(centres)
        rows.append((i, rng.randrange(4), [1.0] * 6 if i % 3 == 0 else [x + rng.choice([0, 0, 0.25, rng.gauss(0, 0.1)]) for x in c]))
    rows += [(i, i % 3, [rng.gauss(0, 1), 1.0]) for i in range(2000, 2400, 20)]
    rows += [(100, None, [1.0] * 6), (200, 1, None), (300, 1, []), (None, 1, [1.0] * 6), (400, 1, [1.0, None]), (500, 1, [float("nan")] * 6), (601, 1, [float("inf")] * 6)]
    rows += rows[:30] + [(700, 9, [5.0] * 6), (800, 1, [0.0] * 6), (900, 2, [-1e6] * 6), (910, 2, [1e6] * 6), (920, 3, [-1e6] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as id", "2 as salt", "3 as cell")
    got = found(df, group=group)
    assert got == brute(rows) and got


def test_bounds_prune_clusters(spark):
    """A row goes only to groups that it might serve: far clusters don't meet."""
    rng = np.random.default_rng(1)
    centres = 50 * np.eye(8)
    vectors = np.concatenate([c + rng.normal(size=(200, 8)) / 10 for c in centres])
    rows = [(i, int(i % 2), v.tolist()) for i, v in enumerate(vectors)]
    classes = op.written(spark, op.classes_of(op.quantised(spark.createDataFrame(rows, SCHEMA)), 6), "t")
    search = op.Search(classes, classes.filter("ids[0] % 100 = 0"), 2)
    search.positives(6)
    routed = classes.select("id", "label", "vector", "ids").mapInArrow(op._routed(search.cells, False), "group long, id long, label long, vector array<int>, ids array<long>")
    assert search.groups >= 8 and routed.count() < 0.5 * classes.count() * search.groups


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()
    assert found(spark.createDataFrame([(1, 1, [1.0]), (100, 1, [1.0])], SCHEMA)) == Counter()
    assert found(spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0]), (102, 2, [0.9])], SCHEMA)) == brute([(100, 1, [1.0]), (101, 1, [1.0]), (102, 2, [0.9])])
