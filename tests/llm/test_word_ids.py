"""Ids of texts from ids of their words, at every code point."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.packing import WordIds

WORDS = WordIds(public_tokenizers.path("word_bpe_49k.json"))
WIDTH = 256


def same(texts: list[str]) -> None:
    whole = [np.array(x.ids, "<u4").tobytes() for x in WORDS.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert WORDS.batch(pa.array(texts)) == whole
    assert [WORDS.ids(x) for x in texts] == whole


def test_every_code_point():
    """Alone and at the end of a word, with punctuation and without."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0xE000 <= c < 0xF900 and not 0x20000 <= c < 0xE0000 and c < 0xE0200]
    for k in range(0, len(points), WIDTH):
        same([" ".join(f"{c}. a{c}. {c} a{c}?! x{c}y.)" for c in points[k : k + WIDTH])])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAzZ.,!?'\"() \nİıßΣςक़ড̸়́̇Ééẞ中ह़가=<>|~0123½  <|endoftext|>", max_size=40), min_size=1, max_size=5))
def test_mixed_scripts(texts):
    same(texts)


def test_turkish_capitals():
    same(["BELEDİYESİ.", "İ.", "Dİ!", "क़. ড়, ঢ়;"])
