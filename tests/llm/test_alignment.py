"""Cross-tokenizer alignment against whole texts encoded by the libraries and all pairs counted."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corvane.llm import token_alignment as op

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best n_best_b count_sum groups_sha256".split()
SCHEMA = "doc_id long, text string"


def brute(rows) -> Counter:
    of, docs, count = op.tokenizers(BYTES, PIECES), [], Counter()
    for doc, text in rows:
        ((a, b),) = of.encoded([text or ""])
        raw = f" {text}".encode()
        if not text or b"".join(of.bytes_a[k] for k in a) != raw or b"".join(of.bytes_b[k] for k in b) != raw:
            docs.append((doc, None))
            continue
        at = [np.cumsum([len(sizes[k]) for k in ids]) for ids, sizes in ((a, of.bytes_a), (b, of.bytes_b))]
        edges = [np.searchsorted(x, np.intersect1d(*at), side="right").tolist() for x in at]
        found = [(a[i:j], b[k:m]) for i, j, k, m in zip([0, *edges[0]], edges[0], [0, *edges[1]], edges[1], strict=False)]
        links = Counter((x, y) for g in found for x in g[0] for y in g[1])
        count.update(links.keys())
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        docs.append((doc, (len(a), len(b), len(found), links, hashlib.sha256(text.encode()).hexdigest())))
    most: list[Counter] = [Counter(), Counter()]
    for pair, n in count.items():
        for side in (0, 1):
            most[side][pair[side]] = max(most[side][pair[side]], n)
    out = Counter()
    for doc, x in docs:
        if x is None:
            out[doc, 0, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            n_a, n_b, n_groups, links, digest = x
            best = [sum(n for p, n in links.items() if count[p] == most[side][p[side]]) for side in (0, 1)]
            out[doc, n_a, n_b, n_groups, sum(links.values()), *best, sum(n * count[p] for p, n in links.items()), digest] += 1
    return out


def found(df, **more) -> Counter:
    return Counter(map(tuple, op.token_alignment(df, BYTES, PIECES, **more).select(*COLUMNS).collect()))


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000").collect()]
    df = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000")
    got = found(df)
    assert got == brute(rows) and sum(got.values()) == len(rows)


@pytest.mark.parametrize("units, chars", [(op.UNITS, op.CHARS), (50, 1000)])
def test_odd_texts(spark, units, chars):
    """White space of all kinds, control strings, combining marks, all code points at each end of a word, nulls, repeated rows."""
    rng = random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", "\t", "a", "the", "Word", "'s", "'", "é", "é", "́", "İ", "ß", "1", "23", ".", "!?", "<|endoftext|>", "<s>", "<0x41>", "▁", " ", "᠎", "​", "　", "\x1c", "\x00", "\x85", "😀", "👨‍👩", "中文", "ह", "﻿", "-----", "ﬁ", "\r\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(600)]
    letters = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows += [(9, " ".join(f"x{c} {c} {c}{c}y" for c in letters[k : k + 97])) for k in range(0, len(letters), 97)]
    rows += [(None, None), (1, ""), (2, " "), (2, " "), (3, "x" * 20_000), (4, "ab " * 5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("doc_id", "text", "1 as block", "2 as kind", "3 as at")
    assert found(df, units=units, chars=chars) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()


def test_merged():
    assert op.merged(np.array([2, 5, 9]), np.array([1, 2, 9])).tolist() == [2, 9] and op.merged(np.array([3]), np.array([1, 2, 3])).tolist() == [3]


def test_whole_texts_where_units_prove_nothing(spark):
    """Without the promise that nothing crosses a space, the text is the unit, with the same rows."""
    of = op.Tokenizers(BYTES, PIECES)
    assert of.in_units and of.units("a b\n c  d") == ["a", "b\n c  d"]
    of.in_units = False
    blocks = [op.Block(0, x) for x in (of, op.tokenizers(BYTES, PIECES))]
    text = "The spaces, and what's between: 12 of them."
    for block in blocks:
        block.add([*dict.fromkeys(block.of.units(text))])
    assert blocks[0].document("1", of.units(text))[4:9] == blocks[1].document("1", blocks[1].of.units(text))[4:9]
