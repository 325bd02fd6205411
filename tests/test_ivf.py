"""Trained cells, and dedup in a stream."""

from __future__ import annotations

import numpy as np
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.vectors import cosine
from corvane.operators import ivf, vector
from corvane.plans import catalogue
from corvane.sources.shared import new_path
from corvane.streaming import jobs


def test_clusters_become_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    data = [(k, (centres[k % 6] + 0.05 * rng.normal(size=12)).tolist()) for k in range(600)]
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [1.0] * 5), (905, [None] * 12)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").repartition(5)
    found = ivf.trained(df, 6)
    cells = {r["id"]: r["cell"] for r in ivf.assigned(ivf.usable(df), found).collect()}
    assert len(cells) == 600 and len({(k % 6, c) for k, c in cells.items()}) == 6
    assert np.allclose(np.linalg.norm(found, axis=1), 1)
    path = new_path(spark, "ivf")
    ivf.stored(df, found, path)
    asked = df.filter("vec_id < 60").selectExpr("vec_id as query_id", "embedding as query_vector")
    near = ivf.probed(spark, path, asked, probes=1)
    rows = lambda x: sorted((r["query_id"], r["rank"], r["id"]) for r in x.collect())
    assert rows(near) == rows(vector.batch_top_k(ivf.usable(df), asked, 5, "id", "vector"))
    assert abs(ivf.share_read(spark, path, asked, 1) - 1 / 6) < 0.01
    plan = spark.read.parquet(f"{path}/cells").filter("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert len(ivf.trained(df.limit(0), 4)) == 0 and len(ivf.trained(df.filter("vec_id = 1"), 4)) == 1


def test_recall_and_share_of_probes(spark, sf):
    """More probes read more and find more; all of them find everything."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    path = new_path(spark, "ivf")
    ivf.stored(df, ivf.trained(df, 16), path)
    asked = df.filter("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    wanted = {(r["query_id"], r["id"]) for r in vector.batch_top_k(df, asked, 5).collect()}
    recall, share = [], []
    for probes in (2, 6, 16):
        found = {(r["query_id"], r["id"]) for r in ivf.probed(spark, path, asked, probes).collect()}
        recall.append(len(found & wanted) / len(wanted))
        share.append(ivf.share_read(spark, path, asked, probes))
    assert recall == sorted(recall) and recall[2] == 1 and share == sorted(share) and share[2] == 1
    assert recall[0] > share[0] and recall[1] > share[1]


def test_a_stream_of_batches_is_deduplicated_as_a_table(spark, sf):
    rows = lambda name: sorted(map(tuple, catalogue.QUERIES[name](spark, sf).select("id", "doc_id", "page_num").collect()))
    assert rows("stream_dedup") == rows("dedup_pipeline")


def test_pages_of_a_stream_are_read_by_key(spark, sf):
    """stream_ingest_pages against the markup's own SQL."""
    import duckdb

    from corvane.plans.stream_queries import PARSED

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    wanted = c.execute(PARSED + "SELECT doc_id, md5(text), item_type FROM r").fetchall()
    got = [(r["doc_id"], r["digest"], r["item_type"]) for r in catalogue.QUERIES["stream_ingest_pages"](spark, sf).collect()]
    assert {x for x in got} <= {x for x in wanted} and len(got) > 0.5 * len(wanted)


def test_nearest_of_odd_vectors_without_pairs_of_all_rows(spark):
    """Copies, ties, zero and null vectors, NaN, other lengths, ids as text: as by cosine() over all pairs, which no join makes."""
    rng = np.random.default_rng(5)
    each = [[float(x) for x in rng.normal(size=4)] for _ in range(60)]
    each += [each[3]] * 9 + [[2 * x for x in each[4]]] * 7 + [[0.0] * 4] * 8 + [[1.0, 2.0]] * 2 + [None, [], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0]]
    df = spark.createDataFrame([(f"v{n}", v) for n, v in enumerate(each)], "vec_id string, embedding array<double>")
    asked = df.filter("cast(substr(vec_id, 2) as int) % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = df.crossJoin(asked).filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    wanted = rows(pairs.withColumn("rank", rank).filter("rank <= 5"))
    for most in (10_000, 4):
        found = vector.batch_top_k(df, asked, 5, most=most)
        assert rows(found) == wanted
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_a_stream_holds_one_state_a_document(spark):
    source, target = new_path(spark, "rows"), new_path(spark, "firsts")
    kind = "doc_id long, at long, text string"
    first = [(k % 3, k, f"a text of some length {k // 3 % 20}") for k in range(180)]
    later = [(k % 3, 1000 + k, f"a text of some length {15 + k // 3}") for k in range(30)] + [(0, 2000, "short"), (0, 2001, "short"), (1, 2002, None)]
    for part in (first, later):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
    out = jobs.first_texts(jobs.file_stream(spark, spark.createDataFrame([], kind).schema, source, 1), ["at"])
    query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_path(spark, "firsts-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [x for p in query.recentProgress for s in p["stateOperators"] for x in [s["numRowsTotal"]]]
    assert max(held) == 3  # a state a text before: 75
    wanted = {}
    for d, at, text in first + later[:30]:
        wanted.setdefault((d, text), at)
    assert rows(spark.read.parquet(target)) == rows(spark.createDataFrame([(d, at, text) for (d, text), at in wanted.items()] + later[30:], kind))
