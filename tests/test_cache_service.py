"""Operations on the cache service, by group."""

from __future__ import annotations

from corvane.sources.shared import new_path
from corvane.streaming import cache_service, jobs

SCHEMA = "seq long, at double, op string, key string, doc string, docs array<string>, results string, ttl double"


def run(spark, *batches):
    source, target = new_path(spark, "ops"), new_path(spark, "answers")
    for rows in batches:
        full = [(k, float(at), op, *(more + [None, None, None, None, None])[:5]) for k, at, op, *more in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cache_service.STORE)
    try:
        out = cache_service.answers(jobs.file_stream(spark, spark.read.parquet(source).schema, source, 1), 3)
        out.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_path(spark, "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(target)


def test_operations_over_two_batches(spark):
    put = lambda seq, at, key, docs, ttl=10.0: (seq, at, "put", key, None, docs, f"of {seq}", ttl)
    first = [put(1, 0, "a", ["x"]), put(2, 0, "b", ["x", "y"]), put(3, 0, "c", []), (4, 1, "get", "a"), (5, 2, "get", "nobody")]
    later = [(6, 10, "get", "a"), (7, 10.5, "get", "b"), (8, 11, "get", "b"), put(9, 12, "b", ["y"]), put(10, 12, "d", ["z"]), put(11, 12, "e", ["z"], 1.0)]
    later += [(12, 13, "invalidate", None, "y"), (13, 13, "get", "b"), (14, 13, "delete", "d"), (15, 13, "get", "d"), (16, 14, "sweep"), (17, 15, "clear"), (18, 15, "get", "c")]
    out = run(spark, first, later)
    gets = {r["seq"]: (r["hit"], r["results"], r["access_count"]) for r in out.filter("op = 'get'").collect()}
    assert gets == {4: (True, "of 1", 1), 5: (False, None, 0), 6: (True, "of 1", 2), 7: (False, None, 0), 8: (False, None, 0), 13: (False, None, 0), 15: (False, None, 0), 18: (False, None, 0)}
    gone = {r["seq"]: r["n"] for r in out.groupBy("seq").agg({"evicted": "sum"}).withColumnRenamed("sum(evicted)", "n").collect()}
    # b goes when it is read too late, then as it names y; c and e by the sweep; a by the sweep too, so clear finds none
    assert gone[7] == 1 and gone[8] == 0 and gone[12] == 1 and gone[14] == 1 and gone[16] == 3 and gone[17] == 0
    assert out.filter("seq = 17").count() == 3
