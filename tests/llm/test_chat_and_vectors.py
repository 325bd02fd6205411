"""Chat formatting and nearest neighbours."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import ann, chat_format

# --- 6

ODD = [
    (1, 0, "system", "be <|im_start|> brief\\"),
    (1, 1, "user", None),
    (1, 2, "assistant", ""),
    (1, 3, "assistant", "a\\<|im_end|>\n"),
    (2, 5, "user", "later"),
    (2, 4, None, "earlier"),
    (2, None, "assistant", "no turn"),
    (3, 1, "assistant", "again"),
    (3, 1, "assistant", "again"),
    (3, 1, "assistant", "a tie"),
    (None, 0, "assistant", "no conversation"),
    (4, 0, "ro\\le\nx<|", "odd role"),
    (5, 0, "assistant", "z" * 200_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as loss", "2 as formatted", "3 as rewrites")


def by_sql(frame):
    c = duckdb.connect()
    c.register("conversations", frame)
    # the test's rows only: without the probe conversation
    return c.execute(chat_format.OP6_SQL).fetchdf().query("conv_id != -1")


def test_digests(spark, odd, sf):
    assert rows(chat_format.digests(chat_format.formatted(odd.filter("turn is not null")))) == rows(by_sql(odd.filter("turn is not null").toPandas()))
    real = spark.read.parquet(f"{sf}/conversations.parquet")
    assert rows(chat_format.digests(chat_format.formatted(real))) == rows(by_sql(real.toPandas()))
    assert chat_format.formatted(odd.limit(0)).count() == 0
    texts = {r["conv_id"]: r["formatted"] for r in chat_format.formatted(odd).collect()}
    assert [t for _, t in chat_format.read_back(texts[2])] == ["no turn", "earlier", "later"]
    assert [t for _, t in chat_format.read_back(texts[3])] == ["a tie", "again", "again"]
    assert chat_format.read_back(texts[4]) == [("ro\\le\nx<|", "odd role")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sy\nstem", ""]), st.text("<|im_end>\\start\n x", max_size=30)), max_size=6))
def test_round_trip(turns):
    out = chat_format.render_spans(chat_format.marked, turns)
    assert chat_format.read_back(out.text) == turns
    assert not out.rewrites
    assert [chat_format.unescape(out.text[a:b]) for a, b in chat_format.loss_spans(out, turns)] == [t for r, t in turns if r == "assistant"]
    assert [out.text[a:b] for a, b, _, _ in out.spans] == [chat_format.marked([t]) for t in turns]


TURNS = [("user", "hello"), ("assistant", "hi"), ("user", "bye"), ("assistant", "see you")]


def test_black_boxes():
    """Templates of other kinds: a fixed end, turns that depend on the one before, rewritten history."""

    def ended(turns):
        return "<s>" + "".join(f"[{r}] {t}\n" for r, t in turns) + "</s>"

    out = chat_format.render_spans(ended, TURNS)
    assert not out.rewrites and [out.text[a:b] for a, b in chat_format.loss_spans(out, TURNS)] == ["hi", "see you"]

    def paired(turns):
        return "".join((f"### {r}:\n" if k == 0 or turns[k - 1][0] != r else "") + t + "\n\n" for k, (r, t) in enumerate(turns))

    twice = [("assistant", "one"), ("assistant", "two"), *TURNS]
    out = chat_format.render_spans(paired, twice)
    assert [out.text[a:b] for a, b in chat_format.loss_spans(out, twice)] == ["one", "two", "hi", "see you"]

    def forgetful(turns):
        return "".join(f"{r}: {t if k == len(turns) - 1 else '...'}\n" for k, (r, t) in enumerate(turns))

    assert chat_format.render_spans(forgetful, TURNS).rewrites
    numbered = lambda turns: f"{len(turns)} turns\n" + "".join(t for _, t in turns)
    assert chat_format.render_spans(numbered, TURNS).rewrites


def test_long_conversations_are_rendered_by_all_prefixes():
    turns = [("assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    out = chat_format.render_spans(chat_format.marked, turns)
    assert not out.rewrites and [out.text[a:b] for a, b in chat_format.loss_spans(out, turns)] == [t for r, t in turns if r == "assistant"]

    def between(low, high):  # a history that only some prefixes show
        return lambda turns: chat_format.marked(turns[5:] if low <= len(turns) < high else turns)

    for low, high in ((101, 200), (299, 300), (300, 999), (40, 41)):
        assert chat_format.render_spans(between(low, high), turns).rewrites


def test_a_rewriting_template_has_no_digests(spark, odd):
    forgetful = lambda turns: chat_format.marked(turns[-1:])
    out = chat_format.formatted(odd.filter("conv_id = 1"), forgetful)
    assert out.first()["rewrites"] and out.first()["loss"] == []
    with pytest.raises(Exception, match="rewrites history"):
        chat_format.digests(out).collect()


def test_rows_without_conversation_are_alone(spark):
    df = spark.createDataFrame([(None, k, "user", "x") for k in range(3)], "conv_id long, turn long, role string, text string")
    assert [r["n_turns"] for r in chat_format.digests(chat_format.formatted(df)).collect()] == [1, 1, 1]


# --- 9


def brute(data, every, k):
    own = [(i, np.asarray(v, float)) for i, v in data if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))]
    own = sorted({(i, tuple(v)) for i, v in own})
    out = {}
    for i, v in own:
        if i % every == 0:
            a = np.array(v)
            near = sorted(((round(float(a @ np.array(w)) / (np.linalg.norm(a) * np.linalg.norm(w)), 12), j) for j, w in own if j != i and len(w) == len(v)), key=lambda x: (-x[0], x[1]))
            if near:
                out[i] = [(j, s) for s, j in near[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, wanted):
    pairs = [(q, i) for q, x in wanted.items() for i, _ in x]
    return sum(i in {j for j, _ in found.get(q, [])} for q, i in pairs) / max(1, len(pairs))


def test_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("label", "class")
    data = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    wanted, found = brute(data, 50, 5), result(ann.nearest(vectors))
    assert recall(found, wanted) >= 0.9
    exact = {i: np.array(v, float) for i, v in data}
    for q, near in found.items():
        assert len(near) == 5 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        for i, s in near:
            assert abs(s - exact[q] @ exact[i] / (np.linalg.norm(exact[q]) * np.linalg.norm(exact[i]))) < 1e-12


def test_clusters_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SALT_ROWS", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    data = [(k, (centres[k % 20] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(600)]
    hot = [(1000 + k, data[0][1]) for k in range(300)]
    df = spark.createDataFrame(data + hot, "vec_id long, embedding array<float>")
    wanted, found = brute(data + hot, 50, 5), result(ann.nearest(df))
    assert recall(found, wanted) >= 0.9
    assert [i for i, _ in found[1000]] == [0, 1001, 1002, 1003, 1004]
    assert [i for i, _ in found[0]] == [1000, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_ties_of_different_vectors(spark, monkeypatch, dense):
    """800 vectors of one direction have one cosine; the smaller vec_id comes first, whichever way blocks are multiplied."""
    monkeypatch.setattr(ann, "DENSE", dense)
    data = [(k, [2.0 ** (k * 7 % 800 - 400) * x for x in (1.0, 2.0, -3.0, 0.5)]) for k in range(800)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = result(ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(6)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(found) == 16
    for q, near in found.items():
        assert [i for i, _ in near] == [i for i in range(6) if i != q][:5]


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(2)
    data = [(k, rng.normal(size=3 + (k % 10 == 0)).tolist()) for k in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert recall(result(ann.nearest(df)), brute(data, 50, 5)) >= 0.9
    assert recall(result(ann.nearest(df, every=7)), brute(data, 7, 5)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [-1.0, 0.1]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (-50, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "2 as class", "3 as vector", "4 as ids")
    found, wanted = result(ann.nearest(df)), brute(data, 50, 5)
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in wanted.items()}
    assert result(ann.nearest(df.limit(0))) == {} and result(ann.nearest(df.filter("vec_id = 0"))) == {}


def test_probes_come_in_order_of_estimated_success():
    sets = ann.perturbations(4, 1000)
    assert len(sets) == 81 == len({tuple(x) for x in sets.tolist()})  # -1, 0 or +1 in each of 4 projections
    assert not (sets[:, :4] * sets[:, :3:-1]).any() and not sets[0].any() and sets[1].tolist() == [1] + [0] * 7
    h = ann.Hasher.drawn(8, 2, 4, 81)
    u = ann.unit(np.random.default_rng(0).normal(size=(50, 8)))
    keys = h.probe_keys(u, 0)
    assert (keys[:, 0] == h.keys(u, 0)).all() and all(len(set(k)) == 81 for k in keys.tolist())
    # what a probe visits is the bucket of a point just beyond the walls it crosses
    at = h.projected(u, 0)
    cells, inside = np.floor(at), at - np.floor(at)
    for i in range(50):
        order = np.argsort(np.concatenate((inside[i], 1 - inside[i])), kind="stable")
        for s, key in zip(h.sets, keys[i], strict=True):
            moved = cells[i].copy()
            for r in np.flatnonzero(s):
                moved[order[r] % 4] += -1 if order[r] < 4 else 1
            assert h.key(h.sums(moved[None], 0), 0)[0] == key


def test_fitted_probes_find_the_asked_share():
    rng = np.random.default_rng(3)
    q = rng.normal(size=(40, 16))
    near = np.repeat(q, 5, axis=0) + 0.5 * rng.normal(size=(200, 16))
    of = np.repeat(np.arange(40), 5)
    for asked in (0.5, 0.95):
        h = ann.fitted(q, near, of, 4, 9, asked)
        found = np.zeros(200, bool)
        for t in range(4):
            found |= (h.probe_keys(ann.unit(q)[of], t) == h.keys(ann.unit(near), t)[:, None]).any(axis=1)
        assert asked <= found.mean() < asked + 0.1
    assert ann.projections_for(10**9) > ann.projections_for(10**6) > ann.projections_for(10**3)
