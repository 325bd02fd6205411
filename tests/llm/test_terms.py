"""Revealing terms of any length, with digits, anywhere in a text."""

from __future__ import annotations

import pytest

from corvane.llm import pii

LONG = "k" * 80 + "7"
FAR = " ".join(f"common{k}" for k in range(30))


@pytest.mark.parametrize("most", [pii.MAX_BROADCAST_TERMS, 0])
def test_whole_tokens_over_whole_texts(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "MAX_BROADCAST_TERMS", most)
    with_one = [(k, f"Li4 Kim A {LONG} {FAR} only{k} quill@mail.example.org {FAR}") for k in range(4)]
    df = spark.createDataFrame([*with_one, (8, f"Kim {FAR}"), (9, None), *((20 + k, f"{FAR} other{k}") for k in range(300))], "doc_id long, text string")
    terms = pii.revealing_terms(df)
    assert {r["term"]: round(r["risk"], 3) for r in terms.collect()} == {"li4": 1.0, "a": 1.0, "kim": 0.949, pii.term(LONG): 1.0}
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(df, terms, remove=2, chars_col=None).collect()}
    assert out[0] == f"[TERM] [TERM] [TERM] [TERM] {FAR} only0 [EMAIL] {FAR}"
    assert out[8] == f"[TERM] {FAR}" and out[9] is None and out[20] == f"{FAR} other0"
