"""Steps whose cost must not grow faster than their input: bounded calls, shuffles and states, with the same results."""

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from corvane.operators import bm25, chunker, context, dedup, plugins, retrieval
from corvane.plans import catalogue
from corvane.sources.shared import new_path, written
from corvane.streaming import cache_service, jobs


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_many_small_documents_are_embedded_together(spark):
    texts = spark.range(1000).select((F.col("id") / 2).cast("long").alias("doc_id"), (F.col("id") % 2).alias("seq"), F.concat(F.lit("words of "), F.col("id")).alias("text"))
    whole = plugins.hashing_embedder(8)

    def embed(texts):
        if len(texts) < 50:
            raise ValueError("a call for each document")
        return whole(texts)

    found = chunker.semantic_chunks(texts, embed)
    assert found.select("doc_id").distinct().count() == 500 and "FlatMapGroups" not in plan(found)


def test_summaries_are_folded_without_a_call_a_group(spark):
    texts = spark.range(700).select((F.col("id") / 7).cast("long").alias("doc_id"), (6 - F.col("id") % 7).alias("rank"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    found = chunker.batched_summaries(texts, str.upper, 2)
    expected = {(d, chunker.batched_summary([f"t{7 * d + 6 - k}" for k in range(7)], str.upper, 2)) for d in range(100)}
    assert {tuple(r) for r in found.collect()} == expected and "FlatMapGroups" not in plan(found)
    pages = texts.select("doc_id", F.lit(1).alias("page_num"), F.col("rank").alias("char_offset_start"), F.lit("x").alias("id"), "text")
    made = {tuple(r) for r in chunker.page_summaries(pages, str.upper, 21).collect()}
    assert made == {(d, 1, 7, "\n\n".join(f"T{7 * d + 6 - k}" for k in range(7))) for d in range(100) if len("\n\n".join(f"t{7 * d + k}" for k in range(7))) >= 21}


def test_a_search_reads_its_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    texts = [(k, None if k == 9 else "" if k == 8 else "one text of many copies" if k % 3 else f"text {k} of its own {'own ' * (k % 5)}") for k in range(200)]
    items = spark.createDataFrame(texts, "id long, text string").repartition(5)
    asked = spark.createDataFrame([("a", "own text text"), ("b", "copies nowhere"), ("c", "nowhere"), (None, "Many 33")], "query_id string, query string")
    found = rows(bm25.search(items.mapInPandas(counted, items.schema), asked, 4))
    assert seen.value == 200 and len(found) == 12
    keep = items.filter("id % 2 = 0").select("id")
    kept = rows(bm25.search(items, asked, 4, keep=keep))
    before, bm25.MAX_BROADCAST = bm25.MAX_BROADCAST, 0  # by joins
    try:
        assert rows(bm25.search(items, asked, 4)) == found and rows(bm25.search(items, asked, 4, keep=keep)) == kept
    finally:
        bm25.MAX_BROADCAST = before
    # an id that occurs twice: its texts are added up
    twice = items.unionByName(items.filter("id = 33"))
    assert len(rows(bm25.search(twice, asked, 300))) == len(rows(bm25.search(items, asked, 300)))


def test_texts_of_hits_are_not_shuffled(spark):
    items = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(6)
    near, asked = spark.createDataFrame([("q", k, 1.0 / k, k) for k in range(1, 9)], "query_id string, id long, score double, rank int"), spark.createDataFrame([("q", "x")], "query_id string, query string")
    for search in (retrieval.hybrid_search, retrieval.fast_search):
        found = search(near, near, items, asked, 3)
        assert [r["text"] for r in found.orderBy("rank").collect()] == ["text 1", "text 2", "text 3"]
        assert "search-hits" in plan(found) and "BroadcastHashJoin [id" in plan(found)


def test_paragraphs_of_sentences_take_one_shuffle(spark, sf):
    found = catalogue.QUERIES["paragraph_context_batch"](spark, sf)
    assert plan(found).split("== Physical")[1].count("Exchange hashpartitioning") == 1 and "Join" not in plan(found)
    data = [("a", 1, "p1", 1, 5, "x."), ("b", 1, "p1", 1, 0, "y."), ("c", 1, "p2", 1, 9, "z."), ("d", 2, "p1", 1, 0, "w."), ("d", 2, "p1", 1, 0, "w."), ("e", None, "p1", 1, 0, "v.")]
    sentences = spark.createDataFrame(data, "id string, doc_id long, paragraph_id string, page_num int, char_offset_start int, text string")
    got = {(r["doc_id"], r["paragraph_id"], r["text"], tuple(r["ids"])) for r in context.paragraphs_of_sentences(sentences).collect()}
    assert got == {(1, "p1", "y. x.", ("b", "a")), (1, "p2", "z.", ("c",)), (2, "p1", "w. w.", ("d", "d"))}


def test_pages_are_deduplicated_after_one_shuffle(spark, sf):
    found = catalogue.QUERIES["dedup_pipeline"](spark, sf)
    assert plan(found).split("== Physical")[1].count("Exchange hashpartitioning") == 1 and "Join" not in plan(found)


def test_scopes_that_fit_a_task_give_what_joins_give(spark):
    rng, data = random.Random(5), [(0, 1, 1, 0, None), (1, 1, 1, 1, " " * 30), (2, 1, 1, 2, " " * 30), (3, 1, 1, 3, "short"), (4, 1, 1, 4, "short"), (5, None, 1, 0, "a text of no document " * 2), (6, None, 1, 1, "a text of no document " * 2)]
    words = [f"word{k}" for k in range(60)]
    for k in range(10, 1500):
        base = words[7 * (k % 4) : 7 * (k % 4) + rng.choice([6, 20, 21])]
        own = [rng.choice(words) if rng.random() < 0.04 else w for w in base]
        data.append((k, 2 + k % 3 if k < 700 else 5, 1 + k % 5 if k < 900 else 6, rng.randrange(10**6), " ".join(own)))
    df = spark.createDataFrame(data, "id int, doc_id long, page_num int, char_offset_start int, text string").repartition(7)
    cut, order = (lambda x: written(spark, x, "test")), ["page_num", "char_offset_start", "id"]
    for threshold in (0.95, 0.7, 1.0):
        made = {fits: {r["id"] for r in dedup.deduplicated(df, ["doc_id"], ["doc_id", "page_num"], order, cut, threshold, fits=fits).collect()} for fits in (True, False)}
        assert made[True] - {5, 6} == made[False] - {5, 6} and {0, 1, 2, 3, 4, 5} & made[True] == {0, 1, 3, 4, 5}


def test_expired_entries_need_no_python_worker(spark):
    source, target = new_path(spark, "writes"), new_path(spark, "expired")
    # a write at the very end of the time to live renews, one a millisecond later doesn't; the watermark must be beyond the end
    data = [("a", 0.0), ("a", 10.0), ("a", 20.001), ("b", 5.0005), ("b", 15.0001), ("c", 30.0), ("d", 40.0)]
    spark.createDataFrame(data, "key string, at double").select("key", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("long")).alias("ts")).write.parquet(source)
    out = jobs.expired_entries(jobs.file_stream(spark, "key string, ts timestamp", source), 10)
    assert "Pandas" not in plan(out)
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", new_path(spark, "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = {(r["key"], r["at"], r["writes"]) for r in spark.read.parquet(target).select("key", F.unix_millis("newest").alias("at"), "writes").collect()}
    assert found == {("a", 10000, 2), ("a", 20001, 1), ("b", 15000, 2)}


class Entries:
    """Map state that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def run(*args):
            self.calls += 1
            if name == "iterator":
                return iter([*self.held.items()])
            if name == "updateValue":
                self.held[args[0]] = args[1]
            return {"updateValue": lambda k, v: None, "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "removeKey": lambda k: self.held.pop(k)}[name](*args)

        return run


def test_a_micro_batch_asks_the_state_once_a_key(monkeypatch):
    import pandas as pd

    rng = random.Random(3)
    kinds = ["put"] * 6 + ["get"] * 20 + ["delete", "invalidate", "sweep", "clear"]
    data = [(float(k), k, rng.choice(kinds), f"k{rng.randrange(9)}", f"d{rng.randrange(3)}", [f"d{rng.randrange(3)}"], f"r{k}", 15.0) for k in range(3000)]
    batches = [pd.DataFrame(data[s : s + 1000], columns=["at", "seq", "op", "key", "doc", "docs", "results", "ttl"]) for s in (0, 1000, 2000)]

    def answers(most):
        monkeypatch.setattr(cache_service, "HELD", most)
        cache = cache_service.Cache()
        cache.entries = Entries()
        cache._begin()
        return [[tuple(map(str, r)) for x in batches for y in cache.handleInputRows((0,), iter([x]), None) for r in y.itertuples(index=False)], cache.entries]

    whole, entries = answers(100)
    assert entries.calls < 3 * 9 * 5
    assert answers(0)[0] == answers(4)[0] == whole

    # a plain map, one operation after the other
    live, n = {}, 0
    for at, seq, op, key, doc, docs, results, ttl in data:
        if op == "put":
            live[key] = [at, docs, results, 0]
        elif op == "get":
            hit = key in live and at - live[key][0] <= ttl
            if not hit:
                live.pop(key, None)
            else:
                live[key][3] += 1
            assert whole[seq][4:7] == (str(hit), str(live[key][2]) if hit else "None", str(live[key][3]) if hit else "0")
            n += hit
        else:
            goes = {"delete": lambda k, x: k == key, "invalidate": lambda k, x: doc in x[1], "sweep": lambda k, x: at - x[0] > ttl, "clear": lambda k, x: True}[op]
            live = {k: x for k, x in live.items() if not goes(k, x)}
    assert n > 300
