"""Operators on small hand-written cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.calculator import calculate, evaluate
from corvane.functions.vectors import cosine
from corvane.operators import bm25, cache, chunker, context, dedup, fusion, markup, memory, plugins, registry, retrieval, sequence, store, vector
from corvane.sources import tables
from corvane.sources.shared import new_path, written
from corvane.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


PAGE = """---
primary_language: en
---
[SECTION]
Methods
[PARAGRAPH]
First line.

Third line.
[DISPLAY_MATH]
$$
a = b
$$
[DISPLAY_MATH]
Fig. 2 shows the flow
[FIGURE]
![A plot](img.png)
[TABLE]
<table></table>"""


def test_markup(spark):
    pages = spark.createDataFrame([("d", 3, PAGE)], "doc_id string, page_num int, markup string")
    items = markup.parsed(pages)
    rows = {r["id"]: (r["item_type"], r["text"], r["char_offset_start"], r["char_offset_end"]) for r in markup.flattened(items).collect()}
    assert rows == {
        "d_p3_para1_s1": ("paragraph", "First line.", 0, 11),
        "d_p3_para1_s3": ("paragraph", "Third line.", 12, 23),
        "d_p3_math1": ("display_math", "$$\na = b\n$$", 0, 11),
        "d_p3_fig1": ("figure", "Fig. 2 shows the flow", 0, 21),
        "d_p3_fig2": ("figure", "A plot", 0, 6),
        "d_p3_table1": ("table", "<table></table>", 0, 15),
    }
    assert {r["id"] for r in markup.cleaned(markup.flattened(items)).collect()} == set(rows) - {"d_p3_fig2"}
    text = markup.rendered(items).first()["text"]
    assert text == "First line. Third line.\n\n$$\na = b\n$$\n\n![Fig. 2 shows the flow]()\n\n![A plot](img.png)\n\n<table></table>"


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (T.without_metadata, "Page 3 of 9\nReal content here.\nCopyright 2020 X", "Real content here."),
        (T.without_metadata, "This open access model is good", ""),
        (T.without_metadata, "a\n\nb", "a\n\nb"),
        (T.sentences, "A b. C d! e", ["A b.", "C d!", "e"]),
        (T.sentences, "v1.2 ok", ["v1.", "2 ok"]),
        (T.sentences, "...", ["..."]),
        (T.token_estimate, "", 2),
        (T.token_estimate, "a b c d e f g h i j", 13),
        (T.table_caption, "Table 2.1: Accuracy\n|a|b|", "Table 2.1: Accuracy"),
        (T.table_caption, "|a|b|\n title ", "title"),
        (T.table_caption, "|a|b|", ""),
        (T.trimmed, " x ", "x"),
        (T.content_type, "|a|b|c|", "table"),
        (T.content_type, "so $$x$$", "formula"),
        (T.content_type, "x = 1 ≤ 2", "formula"),
        (T.content_type, "x = 1", "text"),
        (T.is_figure_caption, "Fig.3", True),
        (T.is_figure_caption, "Curve shows growth", True),
        (T.is_figure_caption, "", False),
        (T.without_tool_calls, 'x <tool_call>{"name":"c","arguments":{}}</tool_call> y <tool_call>{bad</tool_call>', "x  y"),
        (T.word_set, "A a b", ["a", "b"]),
    ],
)
def test_text(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_references_and_calls(spark):
    found = one(spark, T.references, "see Table 2 and [1, 3]")
    assert [(r["ref_type"], r["ref_text"]) for r in found] == [("citation", "see Table 2"), ("numeric_citation", "[1, 3]"), ("direct_reference", "Table 2")]
    calls = one(spark, T.tool_calls, 'x <tool_call>{"name":"c","arguments":{"a":1}}</tool_call> y <tool_call>{bad</tool_call>')
    assert [(c["name"], c["arguments"]) for c in calls] == [("c", '{"a":1}')]
    assert one(spark, T.native_arguments, "{bad") == "{}" and one(spark, T.native_arguments, '{"a":1}') == '{"a":1}'
    assert one(spark, T.truncated, "x" * 20_001).endswith("\n\n[... truncated at 20000 chars]")


def test_jaccard_and_cosine(spark):
    df = spark.createDataFrame([("", ""), ("a b", "B c"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(dedup.near(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1 / 3), 1.0]
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in vectors.select(cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.5**0.5), 0.0, 0.0]


# --- dedup


def greedy(items, threshold, shortest=20):
    """(id, text) in order -> kept ids."""
    hashes, kept, sets = set(), [], []
    for i, t in items:
        if len(t) < shortest:
            kept.append(i)
            continue
        if t in hashes:
            continue
        hashes.add(t)
        w = set(t.lower().split())
        if not any(w | s and len(w & s) / len(w | s) >= threshold for s in sets):
            kept.append(i)
            sets.append(w)
    return kept


def cut(spark):
    return lambda df: written(spark, df, "test")


def test_greedy_is_not_transitive(spark):
    texts = ["alpha beta gamma delta", "beta gamma delta epsilon", "gamma delta epsilon zetas"]
    df = spark.createDataFrame([(k, "d", 1, k, t) for k, t in enumerate(texts)], "id int, doc_id string, page_num int, char_offset_start int, text string")
    out = dedup.deduplicated(df, ["doc_id"], ["doc_id", "page_num"], ["page_num", "char_offset_start", "id"], cut(spark), threshold=0.6)
    assert sorted(r["id"] for r in out.collect()) == [0, 2]


def test_dedup_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(30)]
    rows = []
    for page in range(6):
        base = rng.sample(words, 12)
        for k in range(25):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(12)] = rng.choice(words)
            rows.append((page * 100 + k, page, k, " ".join(own) if k % 6 else "short"))
    df = spark.createDataFrame(rows, "id int, page_num int, char_offset_start int, text string").withColumn("doc_id", F.lit(1))
    out = dedup.deduplicated(df, ["doc_id", "page_num"], ["doc_id", "page_num"], ["page_num", "char_offset_start", "id"], cut(spark), threshold=0.7)
    wanted = [i for page in range(6) for i in greedy([(r[0], r[3]) for r in rows if r[1] == page], 0.7)]
    assert sorted(r["id"] for r in out.collect()) == sorted(wanted)
    again = dedup.deduplicated(out, ["doc_id", "page_num"], ["doc_id", "page_num"], ["page_num", "char_offset_start", "id"], cut(spark), threshold=0.7)
    assert again.count() == len(wanted)


def test_exact_short_texts_bypass(spark):
    df = spark.createDataFrame([(1, "twelve chars"), (2, "twelve chars"), (3, "x" * 20), (4, "x" * 20)], "id int, text string")
    assert {r["id"]: r["first"] for r in dedup.exact_flags(df, [], ["id"]).collect()} == {1: True, 2: True, 3: True, 4: False}


# --- retrieval


def lists(spark):
    v = spark.createDataFrame([("q", "a", 0.8, 1), ("q", "b", 0.4, 2)], "query_id string, id string, score double, rank int")
    k = spark.createDataFrame([("q", "b", 10.0, 1), ("q", "c", 5.0, 2)], "query_id string, id string, score double, rank int")
    return v, k


def scores(df):
    return {r["id"]: pytest.approx(r["score"]) for r in df.collect()}


def test_fusion(spark):
    v, k = lists(spark)
    assert scores(fusion.weighted(v, k)) == {"b": 0.75, "a": 0.5, "c": 0.25}
    assert scores(fusion.reciprocal_rank(v, k)) == {"b": 1 / 62 + 1 / 61, "a": 1 / 61, "c": 1 / 62}
    assert [r["id"] for r in fusion.weighted(v, k, alpha=1.0).orderBy("rank").collect()] == ["a", "b", "c"]
    items = spark.createDataFrame([("a", "text a"), ("b", "text b")], "id string, text string")
    asked = spark.createDataFrame([("q", "what")], "query_id string, query string")
    assert [r["id"] for r in retrieval.hybrid_search(v, k, items, asked, 3).orderBy("rank").collect()] == ["b", "a"]
    fast = retrieval.fast_search(v, k, items, asked, 3).orderBy("rank").collect()
    assert [(r["id"], r["text"]) for r in fast] == [("b", "text b"), ("a", "text a"), ("c", "")]
    assert [r["id"] for r in retrieval.fast_search(None, k, items, asked, 3).orderBy("rank").collect()] == ["b", "c"]
    scored = retrieval.hybrid_search(v, k, items, asked, 1, scorer=lambda q, texts: [t.endswith("a") for t in texts])
    assert [r["id"] for r in scored.collect()] == ["a"]


def test_bm25_repeated_terms_and_filters(spark):
    items = spark.createDataFrame([(1, "Apple pie"), (2, "apple apple tart"), (3, "plum")], "id int, text string")
    asked = spark.createDataFrame([("q", "apple"), ("qq", "apple APPLE")], "query_id string, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in bm25.search(items, asked, 5).collect()}
    assert got["qq", 1] == pytest.approx(2 * got["q", 1]) and ("q", 3) not in got and got["q", 2] > got["q", 1]
    kept = bm25.search(items, asked, 5, keep=items.filter("id = 1")).collect()
    assert {(r["query_id"], r["id"]): r["score"] for r in kept} == {k: pytest.approx(v) for k, v in got.items() if k[1] == 1}


def test_context(spark):
    sents = spark.createDataFrame([(f"s{k:02}", "d", 1, f"p{k // 4}", k * 10, f"t{k}") for k in range(10)], "id string, doc_id string, page_num int, paragraph_id string, char_offset_start int, text string")
    target = spark.createDataFrame([("s00", "d")], "target_id string, doc_id string")
    assert sorted(r["id"] for r in context.context_windows(sents, target).collect()) == ["s00", "s01", "s02"]
    up = context.preceding_paragraphs(sents, spark.createDataFrame([("d", "p1")], "doc_id string, target_paragraph string"))
    assert {r["paragraph_id"]: r["text"] for r in up.collect()} == {"p0": "t0 t1 t2 t3", "p1": "t4 t5 t6 t7"}
    out = retrieval.cumulative_context(up).first()
    assert out["context"] == "=== CONTEXT SUMMARY ===\nt0 t1 t2 t3\n\n=== CURRENT CHUNK (Page 1) ===\nt4 t5 t6 t7" and out["summary_chunks"] == 1


def test_vectors(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [1.0, 1.0])], "vec_id int, g string, embedding array<float>")
    assert [r["id"] for r in vector.top_k(df, [1.0, 0.1], 2).collect()] == [0, 2]
    assert {r["g"]: r["mean"] for r in vector.mean_vectors(df, "g").collect()} == {"a": [0.5, 0.5], "b": [1.0, 1.0]}
    asked = df.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert [(r["id"], r["rank"]) for r in vector.batch_top_k(df, asked, 1).collect()] == [(2, 1)]


# --- memory, cache, sequences

NOW = dt.datetime(2024, 1, 31)


def test_memory(spark):
    week = NOW - dt.timedelta(days=7)
    rows = [(1, "k", "c", "general", week, 0.8), (2, "k2", "c", "Core", week, 0.8), (3, "k3", "c", "general", NOW, None), (4, "assistant_x", "c", "core", NOW, 1.0), (5, "low", "c", "general", week, 0.7), (6, "nan", "c", "general", NOW, float("nan")), (7, "top", "c", "core", NOW, 0.9)]
    df = spark.createDataFrame(rows, "id int, key string, content string, category string, ts timestamp, score double")
    out = memory.ranked(df, F.lit("2024-01-31 00:00:00").cast("timestamp"), 10)
    assert [(r["id"], round(r["final"], 6)) for r in out.collect()] == [(7, 1.0), (2, 0.7), (1, 0.4), (3, 0.4)]
    assert memory.rendered(out).first()["context"] == "[Memory context]\n- top: c\n- k2: c\n- k: c\n- k3: c\n"
    assert memory.rendered(out.limit(0)).first()["context"] == ""
    old = memory.expired(df, F.lit("2024-03-15 00:00:00").cast("timestamp"))
    assert sorted(r["id"] for r in old.collect()) == [1, 2, 3, 5, 6]
    vectors = df.withColumn("embedding", F.when(F.col("id") != 6, F.array(F.lit(1.0), F.col("id").cast("double"))).cast("array<float>"))
    assert [r["id"] for r in memory.recall(vectors, [0.0, 1.0], 1).collect()] == [4]  # of the newest three, one has no vector


def test_cache(spark):
    df = spark.createDataFrame([("a", 100.0, 50, "r7"), ("a", 120.0, 30, "r8"), ("b", 100.0, 49, "r9")], "key string, created_at double, ttl_seconds int, results string").withColumn("access_count", F.lit(2))
    assert {r["key"]: r["created_at"] for r in cache.latest(df).collect()} == {"a": 120.0, "b": 100.0}
    assert cache.live(df, 150.0).count() == 2 and cache.expired(df, 150.0).count() == 1  # an age of just the ttl is live, and not swept
    assert cache.statistics(df, 150.0).first()["hits"] == 6
    assert [r["results"] for r in cache.invalidated(df, "7").collect()] == ["r8", "r9"]
    key = lambda q, k: spark.range(1).select(cache.cache_key(F.lit(q), F.lit("{}"), F.lit(k), F.lit(0.5), F.lit("w"))).first()[0]
    assert key(" Query ", 3) == key("query", 3) != key("query", 10)


def calls(spark, tools, ok=None, args=None):
    rows = [(1, k, k, t, (args or ["a"] * len(tools))[k], "r", True if ok is None else ok[k]) for k, t in enumerate(tools)]
    return spark.createDataFrame(rows, "session_id long, seq long, iteration long, tool string, args_hash string, result_hash string, success boolean")


def verdicts(df, **options):
    return [(r["rule"], r["verdict"]) for r in sequence.verdicts(df, **options).orderBy("seq").collect()]


def test_loops(spark):
    go, warn, stop = "CONTINUE", "INJECT_WARNING", "HARD_STOP"
    assert [v for _, v in verdicts(calls(spark, ["t", "T", "t", "t"]))] == [go, go, warn, stop]
    assert verdicts(calls(spark, ["a", "b", "a", "b"]))[3] == ("ping_pong", warn)
    mixed = calls(spark, ["a", "b", "a", "c", "a", "a"], [False, False, False, False, False, True], list("uvwxyz"))
    assert verdicts(mixed) == [(None, go)] * 4 + [("failure_streak", warn), (None, go)]
    assert all(r is None for r, _ in verdicts(calls(spark, ["t"] * 4), repeats=0))
    assert all(r is None for r, _ in verdicts(calls(spark, ["a", "b", "a", "b"]), cycles=1))


def test_histories(spark):
    rows = [(1, k, "system" if k == 0 else "user" if k % 2 else "assistant", f"m{k}") for k in range(25)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = sequence.compacted(df.filter("turn < 21")).orderBy("pos").collect()
    assert len(out) == 5 and out[0]["text"] == "Previous conversation: 8 user queries, 8 assistant responses." and [r["text"] for r in out[1:]] == ["m17", "m18", "m19", "m20"]
    assert sequence.compacted(df.filter("turn < 20")).count() == 20
    kept = [r["turn"] for r in sequence.trimmed_history(df).orderBy("turn").collect()]
    assert kept == [0, *range(6, 25)]
    assert [r["turn"] for r in sequence.trimmed_history(df.filter("turn > 0")).orderBy("turn").collect()] == [*range(5, 25)]


# --- folds, plug-ins, store


def test_chunks():
    sentences = [f"Sentence number {k} talks." for k in range(40)]
    flat = lambda texts: [[1.0, 0.0]] * len(texts)
    found = chunker.chunked(sentences, flat, max_tokens=30)
    assert all(a[-1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert [s for k, c in enumerate(found) for s in (c if k == 0 else c[1:])] == sentences
    turned = lambda texts: [[1.0, 0.0] if k < 5 else [0.0, 1.0] for k in range(len(texts))]
    assert chunker.chunked(sentences[:10], turned, overlap=0) == [sentences[:5], sentences[5:10]]


def test_summaries():
    assert chunker.batched_summary([], str.upper) == "" and chunker.batched_summary(["x"], str.upper) == "x"
    assert chunker.batched_summary(["a", "b", "c"], str.upper, batch=2) == "A\n\nB\n\nC"

    def broken(prompt):
        raise RuntimeError("down")

    assert chunker.batched_summary(["a", "b", "c"], broken, batch=2) == "[Chunks 1-2]: a... ... b\n[Chunks 3-3]: c... ... "


def test_retry_and_tokens():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return "done"

    assert plugins.with_retry(flaky, sleep=waits.append) == "done" and waits == [2.0, 4.0, 8.0]
    m = plugins.TokenManager(str.split, " ".join)
    assert m.count("a b c") == 3 and m.truncate("a b c", 2) == "a b" and m.within("a b", 2)


def test_calculator(spark):
    assert evaluate("2 + 3 * sqrt(16) ^ 2") == 50
    for bad in ("__import__('os')", "a.b", "9**9999", "1/0", "", "print(1)"):
        with pytest.raises(ValueError):
            evaluate(bad)
    df = spark.createDataFrame([("1+1",), ("x",), (None,)], "e string")
    assert [r[0] for r in df.select(calculate("e")).collect()] == [2.0, None, None]


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([("a", "f", 0, None, None, NOW), ("b", "g", 0, "processing", "{}", NOW)], store.DOCUMENTS)
    log = spark.createDataFrame([("a", "completed", 1), ("a", "failed", 2)], "doc_id string, status string, ts int")
    assert {r["doc_id"]: r["status"] for r in store.with_status(docs, log).collect()} == {"a": "failed", "b": "processing"}
    assert store.lookup(docs, "a").first()["status"] == "processing"
    assert [r["doc_id"] for r in store.without(docs, docs.filter("doc_id = 'a'")).collect()] == ["b"]
    new = spark.createDataFrame([("x", None), ("y", "table")], "id string, item_type string")
    assert [(r["id"], r["item_type"]) for r in store.insertable(new, new.filter("id = 'y'")).collect()] == [("x", "paragraph")]
    with pytest.raises(ValueError):
        store.insertable(new.unionByName(new), new)
    path = str(tmp_path / "t")
    for _ in range(3):
        store.append(new.repartition(2), path)
    store.compact(spark, path, path + "2")
    assert spark.read.parquet(path + "2").count() == 6 and len([*(tmp_path / "t2").glob("*.parquet")]) == 1


def test_registry():
    r = registry.ToolRegistry().register(registry.Tool("a", lambda x: x + 1)).register(registry.Tool("a", lambda x: x + 2))
    assert r.execute("a", x=1)["output"] == 3 and not r.execute("b")["success"] and not r.execute("a", y=1)["success"]
    ok = registry.Approvals()
    ok.deny("a")
    assert not ok.is_approved("a") and ok.is_approved("new")
    assert registry.assembled_prompt([lambda: "a ", lambda: " ", lambda: 1 / 0, lambda: "b"]) == "a\n\nb"
    assert registry.formatted_hits([{"filename": "f.pdf", "page_num": 2, "text": "t"}]) == "[1] f.pdf (Page 2):\nt"


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12")
    (tmp_path / "b.PDF").write_bytes(b"1")
    files = tables.pdf_files(spark, str(tmp_path))
    pages = tables.pdf_pages(files, len)

    def extract(content, n):
        if n == 2:
            raise ValueError("unreadable")
        return f"[PARAGRAPH]\npage {n}"

    out = tables.extracted_pages(pages, extract)
    assert sorted((r["page_num"], r["markup"], r["error"]) for r in out.collect()) == [(1, "[PARAGRAPH]\npage 1", None), (2, None, "ValueError: unreadable")]
    assert [r["page_num"] for r in tables.failed_pages(out, pages).collect()] == [2]
    (tmp_path / "w.txt").write_text("x" * 30)
    assert tables.workspace_files(spark, [str(tmp_path / "w.txt")], 10).first()["content"] == "x" * 10 + "\n\n[... truncated at 10 chars]"


def test_ingestion_is_idempotent(spark):
    source, target = new_path(spark, "src"), new_path(spark, "dst")
    pages = spark.createDataFrame([("d", 1, PAGE), ("d", 2, PAGE)], "doc_id string, page_num int, markup string")
    pages.write.parquet(source)
    told = []
    for k in range(2):  # a second run from the start finds all pages stored
        stream = jobs.file_stream(spark, pages.schema, source)
        jobs.ingest_pages(stream, target, new_path(spark, f"cp{k}"), lambda rows, n: told.append(n)).awaitTermination()
    assert spark.read.parquet(target).count() == 10 and len(told) == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["a b", "b a", "a", "c d e", "short"]), max_size=8))
def test_greedy_brute_force_is_idempotent(texts):
    items = [(k, t * 8) for k, t in enumerate(texts)]
    kept = greedy(items, 0.5)
    again = [i for i in items if i[0] in kept]
    assert greedy(again, 0.5) == kept
