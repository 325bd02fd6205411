"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest

from test_documents import ODD, brute_components, brute_fingerprint, check_packed, frame, naive
from test_near_copies import brute_groups

from corvane.llm.common import written
from corvane.llm.near_dedup import first_of_each
from corvane.llm.quality_rules import OP3_SQL


@pytest.fixture(scope="module")
def stages(spark, sf):
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := written(spark, stage(spark, docs, sf), f"test-{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii", "packing"]


def test_quality(stages, duck):
    """Just the documents that the rules' own SQL keeps."""
    before, after = map(texts, stages["quality_rules"])
    kept = {i for (i,) in duck.execute(f"SELECT doc_id FROM ({OP3_SQL}) WHERE kept").fetchall()}
    assert set(after) == kept and 0 < len(kept) < len(before) and all(before[i] == t for i, t in after.items())


def test_near_dedup(stages):
    """The stage links five-word similarity of 0.8 or more besides op7's bits: all pairs, by brute force."""
    before, after = map(texts, stages["near_dedup"])
    groups = brute_groups([*before.items()], corpus_pipeline.JACCARD)
    assert set(after) == set(groups.values())
    assert len(set(after)) < len({c for _, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in before.items()])})
    assert all(before[i] == t for i, t in after.items())


def test_pii(stages):
    before, after = map(texts, stages["pii"])
    assert set(before) == set(after)
    for i, t in before.items():
        found = naive(t)
        for spans in found.values():
            for a, b in spans:
                assert t[a:b] not in after[i]
        if not any(found.values()):
            assert after[i] == t
    assert all(r["n_chars"] == len(r["text"]) for r in stages["pii"][1].collect())


def test_packing(stages):
    before, after = stages["packing"]
    check_packed(after.collect(), [*texts(before).items()], padding=0.05)


def test_columns(stages):
    for name in ("quality_rules", "near_dedup", "pii"):
        before, after = stages[name]
        assert before.columns == after.columns and before.dtypes == after.dtypes


def test_run(spark, sf, stages):
    out = corpus_pipeline.run(spark, sf)
    assert out.select("doc_id", "start", "length", "ids_crc32").exceptAll(stages["packing"][1].select("doc_id", "start", "length", "ids_crc32")).count() == 0


def test_repeated_rows_with_other_columns(spark):
    """Of rows with one id and text the same one stays, however they are dealt."""
    text = "some words of a text that comes twice with another source each time it comes"
    df = spark.createDataFrame([(1, text, f"s{k}") for k in range(8)], "doc_id long, text string, source string")
    kept = {tuple(r["source"] for r in first_of_each(df.repartition(n), jaccard=corpus_pipeline.JACCARD).collect()) for n in (1, 3, 5)}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, ""), "odd")
    assert docs.count() > 0
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, ""), "none")
    assert docs.count() == 0
