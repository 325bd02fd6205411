"""As-of recall for many messages against each message's own search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corvane.operators import memory


@pytest.mark.parametrize("slot", [1, 7, 10_000])
def test_recalled_is_recall_before_each_message(spark, slot):
    rng = random.Random(8)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    memories = [(k, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *map(float, range(40))]), rng.choice([None, vector(), vector()])) for k in range(300)]
    messages = [(k, rng.choice([1, 2, 3, None]), rng.choice([None, *map(float, range(45))]), vector()) for k in range(60)]
    got: dict = {}
    out = memory.recalled(spark.createDataFrame(memories, "id long, session_id long, at double, embedding array<double>"), spark.createDataFrame(messages, "message_id long, session_id long, at double, query_vector array<double>"), 2, slot)
    for r in out.orderBy("message_id", "rank").collect():
        got.setdefault(r["message_id"], []).append(r["id"])
    wanted = {}
    for m, session, at, q in messages:
        if session is None or at is None:
            continue
        newest = sorted((x for x in memories if x[1] == session and x[2] is not None and x[2] < at), key=lambda x: (-x[2], x[0]))[:6]
        score = lambda x, q=q: -round(float(np.dot(x, q) / np.linalg.norm(x) / np.linalg.norm(q)), 9)
        best = sorted((score(x[3]), x[0]) for x in newest if x[3] is not None)[:2]
        if best:
            wanted[m] = [i for _, i in best]
    assert got == wanted
