"""Bounds that change no result, stores that fail, and queries without SQL against brute force."""

from __future__ import annotations

import math
import re
import time

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import greedy

from corvane.operators import chunker, dedup, ingestion, plugins, registry, retrieval, sequence, store, vector
from corvane.plans import catalogue
from corvane.sources.corpus import sentences
from corvane.sources.shared import file_system, new_path, released, written


@pytest.fixture
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- bounds


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(300)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert rows(vector.batch_top_k(df, asked, 3)) == rows(vector.batch_top_k(df, asked, 3, most=7)) and vector.batch_top_k(df, asked, 3, most=7).count() == 300


def test_places_in_a_list_of_many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        own = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("some text").alias("t"))
        out = store.numbered(spark, own.orderBy("x"), "pos").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["x"], r["pos"]) for r in out) == [(k, k + 1) for k in range(5000)]


def test_groups_of_copies_are_joined_by_heads(spark, monkeypatch):
    data = [(k, "one and the same text of many") for k in range(50)] + [(100 + k, f"text number {k} of its own words w{k} v{k}") for k in range(20)] + [(200, None)]
    df = spark.createDataFrame(data, "id long, text string")
    a = rows(dedup.similar_pairs(df, 0.8))
    monkeypatch.setattr(dedup, "HOT_GROUPS", 10**9)
    assert rows(dedup.similar_pairs(df, 0.8)) == a and len(a) >= 49
    flags = {r["id"]: r["first"] for r in dedup.exact_flags(df, [], ["id"]).collect()}
    assert {k for k, v in flags.items() if v} == {0, 200, *range(100, 120)}


def test_similar_pairs_are_those_of_brute_force(documents):
    data = {r["doc_id"]: frozenset(re.split(r"\s+", r["text"].lower())) - {""} for r in documents.collect()}
    found = {(r["a"], r["b"]) for r in dedup.similar_pairs(documents.select(F.col("doc_id").alias("id"), "text"), 0.6).filter("not copy").collect()}
    least = {}
    for i, w in sorted(data.items()):
        least.setdefault(w, i)
    heads = {i: w for w, i in least.items() if w}
    assert found == {(a, b) for a, x in heads.items() for b, y in heads.items() if a < b and len(x & y) >= 0.6 * len(x | y) - 1e-12}


def test_released_tables_are_gone(spark):
    kept, gone = (written(spark, spark.range(3).toDF("id"), n) for n in ("kept", "gone"))
    released(spark, gone)
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        gone.collect()


# --- stores and services that fail


def sentence_frame(spark, ids, text="a sentence of words"):
    return spark.createDataFrame([(i, i % 3, 1, "p", f"{text} {i}", "paragraph") for i in ids], "id long, doc_id long, page_num int, paragraph_id string, text string, item_type string")


def test_three_stores(spark):
    waits, broken, calls = [], {"postings"}, []

    def layer(name, make):
        def run(x):
            calls.append(name)
            if name in broken:
                raise RuntimeError(name)
            return make(x)

        return run

    makers = {"sentences": ingestion.sentence_rows, "vectors": ingestion.vector_rows(plugins.hashing_embedder(8)), "postings": ingestion.posting_rows}
    own = ingestion.Stores(spark, new_path(spark, "stores"), retries=2, sleep=waits.append, layers={n: layer(n, f) for n, f in makers.items()})
    assert not own.ingest(1, sentence_frame(spark, range(6)))
    assert waits == [2.0, 4.0] and own.failed() == [1] and calls == ["sentences", "vectors", "postings", "postings", "postings"]
    broken.clear()
    assert own.ingest(2, sentence_frame(spark, range(10, 13)))
    assert {r["id"] for r in own.read("sentences").collect()} == {10, 11, 12}  # nothing of the failed batch is left
    assert own.replay() == 1 and own.failed() == [] and own.read("vectors").count() == 9
    assert own.ingest(3, sentence_frame(spark, [10], "a new version"))
    texts = {r["id"]: r["text"] for r in own.read("sentences").collect()}
    assert texts[10] == "a new version 10" and len(texts) == 9
    assert {r["term"] for r in own.read("postings").filter("id = 10").collect()} == {"a", "new", "version", "10"}
    own.delete(spark.createDataFrame([(1,)], "doc_id long"), 3)
    for name in makers:
        assert own.read(name).filter("doc_id = 1").count() == 0 < own.read(name).count()
    assert own.ingest(4, sentence_frame(spark, [1]))  # a document that comes again counts
    assert [r["id"] for r in own.read("sentences").filter("doc_id = 1").collect()] == [1]


def test_stream_into_three_stores(spark):
    source, told = new_path(spark, "source"), []
    frame = sentence_frame(spark, range(9))
    frame.write.parquet(source)
    own = ingestion.Stores(spark, new_path(spark, "stores"), sleep=lambda _: None)
    ingestion.ingest_stream(spark.readStream.schema(frame.schema).parquet(source), own, new_path(spark, "cp"), lambda n, ok: told.append(ok)).awaitTermination()
    assert told == [True] and own.read("sentences").count() == own.read("vectors").count() == 9


def test_batches_that_fail():
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError
        return np.ones((len(texts), 2))

    good = plugins.embedded_in_batches(["a", "b", "bad", "c"], embed, batch=2)
    assert good == [[1, 1], [1, 1], [0, 0], [0, 0]]
    with pytest.raises(RuntimeError):
        plugins.embedded_in_batches(["bad"], embed, batch=2)
    tries, waits = [], []

    def second(texts):
        tries.append(1)
        if len(tries) < 2:
            raise RuntimeError
        return np.zeros((len(texts), 1))

    assert plugins.embedded_in_batches(["a"], second, attempts=3, sleep=waits.append) == [[0.0]] and waits == [2.0]


def test_reranking_falls_back(spark):
    own = spark.createDataFrame([("q", k, f"text {k}", 1.0 - k / 10, k + 1) for k in range(4)] + [("r", 9, "x", 0.5, 1)], "query_id string, id int, text string, score double, rank int")
    asked = spark.createDataFrame([("q", "good"), ("r", "bad")], "query_id string, query string")

    def scorer(query, texts):
        if query == "bad":
            raise RuntimeError
        return [float(t.split()[1]) for t in texts]

    out = [(r["query_id"], r["id"], r["score"]) for r in plugins.reranked(own, asked, 2, scorer).orderBy("query_id", "rank").collect()]
    assert out == [("q", 3, 3.0), ("q", 2, 2.0), ("r", 9, 0.5)]


def test_tools_at_once():
    tools = registry.ToolRegistry().register(registry.Tool("wait", lambda s: time.sleep(s) or s)).register(registry.document_search(lambda q, k, d: [{"text": f"{q} {k} {d}", "filename": "f", "page_num": 2}] if q != "none" else []))
    began = time.monotonic()
    out = tools.execute_many([("wait", {"s": 0.2})] * 4 + [("wait", {"s": 3})], timeout=0.6)
    assert time.monotonic() - began < 2 and [x["success"] for x in out] == [True] * 4 + [False] and "timed out" in out[4]["error"]
    assert [x["success"] for x in tools.execute_many([("wait", {"s": 0}), ("wait", {"s": 1})], timeout=0.3, parallel=False)] == [True, False]
    assert tools.execute("document_search", query="x", doc_id="7")["output"] == "[1] f (Page 2):\nx 5 7"
    assert not tools.execute("document_search")["success"] and "No document" in tools.execute("document_search", query="none")["output"]
    assert registry.researched(tools, "x")[0]["content"].startswith("[1] f") and registry.researched(registry.ToolRegistry(), "x") == []


def test_sessions(spark):
    log = [(1, "create", 1, "a"), (1, "update", 2, "b"), (2, "create", 1, "c"), (2, "delete", 5, None), (3, "create", 1, "d"), (3, "delete", 2, None), (3, "update", 3, "e")]
    out = sequence.sessions_of_log(spark.createDataFrame(log, "session_id int, op string, ts int, metadata string")).orderBy("session_id").collect()
    assert [(r["session_id"], r["created_at"], r["updated_at"], r["metadata"]) for r in out] == [(1, 1, 2, "b"), (3, 3, 3, "e")]


def test_search_end_to_end(spark, documents):
    sents = sentences(documents.limit(30)).cache()
    embed = plugins.hashing_embedder(16)
    vectors = plugins.embedded(sents.select("id", "text"), embed).select("id", "embedding")
    first = sents.filter("length(text) > 40").orderBy("id").first()
    asked = spark.createDataFrame([("q", first["text"])], "query_id string, query string")
    out = retrieval.search(sents, vectors, asked, embed, 3).orderBy("rank").collect()
    assert out[0]["doc_id"] == first["doc_id"] and first["text"] in out[0]["text"] and [r["rank"] for r in out] == [1, 2, 3]
    whole = retrieval.search(sents, vectors, asked, embed, 3, cumulative=True).collect()
    assert len(whole) == 3 and all(r["context"].endswith(f"=== CURRENT CHUNK (Page {r['page_num']}) ===\n{r['text']}") for r in whole)
    other = retrieval.search(sents, vectors, asked, embed, 3, where=F.col("doc_id") != first["doc_id"], fast=True, paragraphs=False).collect()
    assert len(other) == 3 and all(r["doc_id"] != first["doc_id"] for r in other)


# --- queries without SQL


def test_fuzzy_documents(spark, sf, documents):
    sets, kept = [], []
    for r in documents.orderBy("doc_id").collect():
        w = {x for x in re.split(r"\s+", r["text"].lower()) if x}
        if not any((w | s) and len(w & s) / len(w | s) >= 0.95 - 1e-12 for s in sets):
            kept.append(r["doc_id"])
            sets.append(w)
    assert sorted(r["id"] for r in catalogue.QUERIES["dedup_fuzzy_docs"](spark, sf).collect()) == kept


def test_dedup_pipeline(spark, sf, documents):
    pages, seen = {}, set()
    for r in sentences(documents).orderBy("doc_id", "page_num", "char_offset_start", "id").collect():
        if len(r["text"]) >= 20 and (r["doc_id"], r["text"]) in seen:
            continue
        seen.add((r["doc_id"], r["text"]))
        pages.setdefault((r["doc_id"], r["page_num"]), []).append((r["id"], r["text"]))
    wanted = sorted(i for items in pages.values() for i in greedy(items, 0.95))
    assert sorted(r["id"] for r in catalogue.QUERIES["dedup_pipeline"](spark, sf).collect()) == wanted


def test_embedded_texts(spark, sf, documents):
    embed = plugins.hashing_embedder(16)
    wanted = {r["doc_id"]: embed([r["text"]])[0].astype(float) for r in documents.collect()}
    out = catalogue.QUERIES["embed_texts"](spark, sf).collect()
    assert len(out) == len(wanted) and all(np.allclose(r["embedding"], wanted[r["id"]], atol=1e-5) for r in out)


def test_semantic_chunks(spark, sf, documents):
    embed, expected = plugins.hashing_embedder(), []
    texts = {}
    for r in sentences(documents).orderBy("doc_id", "page_num", "char_offset_start").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    size = lambda x: math.ceil(len(re.split(r"\s+", x)) * 1.3)
    for doc, own in texts.items():
        vectors, chunks, now = embed(own).astype(float), [], [0]
        for k in range(1, len(own)):
            if chunker.cosine(vectors[now].mean(axis=0), vectors[k]) < 0.7 or sum(size(own[i]) for i in now) + size(own[k]) > 512:
                chunks.append(now)
                now = [now[-1], k]
            else:
                now = [*now, k]
        for n, c in enumerate([*chunks, now]):
            whole = " ".join(own)
            expected.append((doc, n, whole.index(own[c[0]]), whole.index(own[c[-1]]) + len(own[c[-1]]), sum(size(own[i]) for i in c), len(c)))
    names = ["doc_id", "chunk_no", "start_idx", "end_idx", "token_count", "n_sentences"]
    assert sorted(tuple(r[n] for n in names) for r in catalogue.QUERIES["semantic_chunks"](spark, sf).collect()) == sorted(expected)


def test_streamed_pages_are_those_of_a_batch(spark, sf):
    from corvane.operators.markup import cleaned, flattened, parsed
    from corvane.plans.stream_queries import _pages

    own = cleaned(flattened(parsed(_pages(spark, sf)))).select("id", "doc_id", "item_type", "char_offset_start", F.md5("text").alias("digest"))
    assert rows(catalogue.QUERIES["stream_ingest_pages"](spark, sf)) == rows(own)


def test_prefixes_hold_no_word_set_a_word():
    """300 sets of 2,000 words have 120,300 prefix words: 2 GB if each of those rows holds its set."""
    from types import SimpleNamespace

    import pyarrow as pa

    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    classes = SimpleNamespace(sparkSession=session, dtypes=[("id", "bigint"), ("n", "int"), ("words", "array<bigint>")], select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: run))
    words = np.arange(600_000) * 7919
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([2000] * 300, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, 600_001, 2000), pa.int32()), pa.array(words))], names=["id", "n", "words"])
    before, pool = pa.default_memory_pool(), pa.system_memory_pool()
    pa.set_memory_pool(pool)
    try:
        found = pa.Table.from_batches(dedup._prefixes(classes, np.ones(dedup.COUNTED, np.int64), 0.8, [])([batch]))
    finally:
        pa.set_memory_pool(before)
    assert found.num_rows == 300 * 401 and found.column_names == ["id", "n", "at", "word"]
    assert pool.max_memory() < 64 << 20
    assert set(found["word"].to_pylist()[:401]) == set(words[:401].tolist())


def test_candidates_are_verified_in_rounds_of_bounded_size(spark, monkeypatch):
    texts = [(g * 10 + k, " ".join([f"g{g}w{x}" for x in range(20)] + [f"own{g}_{k}"] * (k > 1))) for g in range(30) for k in range(5)]
    df = spark.createDataFrame(texts, "id long, text string")
    one = rows(dedup.similar_pairs(df, 0.8))
    made, write = [], dedup.written
    monkeypatch.setattr(dedup, "VERIFIED_AT_ONCE", 8_000)
    monkeypatch.setattr(dedup, "written", lambda spark, x, name: made.append((name, write(spark, x, name))) or made[-1][1])
    assert rows(dedup.similar_pairs(df, 0.8)) == one and len(one) == 30 * 7
    tables = [x for name, x in made if name == "near-pairs"]
    assert len(tables) == 4 and max(x.count() for x in tables) < 100 and sum(x.count() for x in tables) == 30 * 6
    # the sets themselves, the prefixes and the candidates are gone by then
    assert {name for name, x in made if not file_system(spark, x._written_at)[0].exists(file_system(spark, x._written_at)[1])} == {"word-sets", "word-prefixes", "word-pairs"}
