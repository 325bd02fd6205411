"""Near copies by exact five-word similarity, against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from test_documents import brute_components, brute_fingerprint, low, words

from corvane.llm import near_dedup


def shingles(text):
    w = words(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(data, jaccard):
    """Components of op7's links and of all pairs at or over jaccard, by id."""
    root = {i: i for i, _ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_prints = {i: c for i, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in data])}
    sets = {i: shingles(t) for i, t in data}
    for i, c in by_prints.items():
        root[find(i)] = find(c)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= jaccard * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i in sorted(root):
        least.setdefault(find(i), i)
    return {i: least[find(i)] for i in root}


@pytest.fixture(scope="module")
def copies():
    """Texts with 2 to 9 words of 200 replaced: small groups, and one of 60 in which many pairs are too far apart."""
    rng, data = random.Random(3), []
    for group, size in [(k, 4) for k in range(12)] + [(99, 60)]:
        base = [f"g{group}w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(size):
            text = list(base)
            for at in rng.sample(range(200), rng.randrange(2, 10)):
                text[at] = f"n{rng.randrange(10**6)}"
            data.append((len(data) + 1, " ".join(text)))
    return [*data, (1000, "two words"), (1001, "Two  WORDS"), (1002, "")]


def test_components_are_those_of_all_pairs(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    expected = brute_groups(copies, 0.8)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, jaccard=0.8).collect()}
    assert found == expected
    assert len({*expected.values()}) < len({c for _, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in copies])})


def test_stage(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(kept) == sorted({*brute_groups(copies, 0.8).values()})
