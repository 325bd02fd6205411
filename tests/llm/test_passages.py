"""Substring dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import substring_dedup as op
from corvane.llm.common import words_of

SCHEMA = "doc_id long, text string"


def brute(rows) -> Counter:
    first: dict[tuple, int] = {}
    size, last = op.SIZE, op.LAST
    for doc, text in rows:
        words = words_of(text)
        for k in range(len(words) - size + 1):
            first[x] = min(first.get(x := tuple(words[k : k + size]), last), last if doc is None else doc)
    out = Counter()
    for doc, text in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (last if doc is None else doc):
                gone[k : k + size] = [True] * size
        out[doc, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def found(df, **more) -> Counter:
    return Counter(map(tuple, op.substring_dedup(df, **more).collect()))


def test_documents(spark, sf, duck):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(map(tuple, op.op12_substring_dedup(spark, sf).collect()))
    assert got == brute(rows) and any(r[2] for r in got)
    assert got == Counter(duck.execute(op.OP12_SQL).fetchall())


@pytest.mark.parametrize("patterns", [op.PATTERNS, 7])
def test_odd_rows(spark, patterns):
    """Nulls, empty and very long words, equal ids, repeated rows, a passage in most documents, several automata a shard."""
    rng = random.Random(3)
    words = ["a", "b", "cc", "é", "ß" * 40]

    def text() -> str:
        return rng.choice(" \n\t").join(rng.choice(words) for _ in range(rng.choice([0, 1, 12, 13, 14, 30, 200])))

    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, "", text(), text(), text()])) for _ in range(40)]
    rows += rows[:20] + [(8, "w" * 300_000 + " " + text()), (6, "w" * 300_000 + " " + text())]
    phrase = " ".join(f"x{i}" for i in range(14))
    rows += [(i, f"u{i} {phrase} v{i}") for i in range(200)] + [(9, phrase)] * 50 + [(3, phrase)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("doc_id", "text", "'x' as shard", "1 as key", "2 as n")
    assert found(df, shard_bytes=3000, patterns=patterns) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()
    assert found(spark.createDataFrame([(1, None), (None, "a")], SCHEMA)) == brute([(1, None), (None, "a")])


def test_word_digests():
    """The digest of a word doesn't depend on its block or place."""
    words = [b"one", b"two", b"x" * 70, b"y" * (op.BLOCK + 5), b"one"] + [b"%d" % k for k in range(200_000)] + [b"two", b"x" * 70]
    h = op.word_digests(words)
    assert len(h) == len(words) and h[0] == h[4] and h[1] == h[-2] and h[2] == h[-1]
    assert len(np.unique(h)) == len(set(words))


def test_one_row_a_shard_and_no_exchange_of_texts(spark, sf):
    """The bucketed texts are grouped by shard without being moved."""
    from corvane.llm.common import bucketed, dropped

    df = spark.range(100).selectExpr("cast(id % 7 as int) as shard", "id").repartition(4, "shard")
    table = bucketed(spark, df, 4, "shard", "test_buckets")
    plan = table.groupBy("shard").applyInArrow(lambda t: t, "shard int, id long")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    dropped(spark, table)
