"""Folds over the sentences of a document: semantic chunks and batched summaries.

Both are sequential by definition, so each document's bounded list of sentences is one row; a task folds row after row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.plugins import Embedder, Summarizer, hashing_embedder, with_retry

MAX_TOKENS, THRESHOLD, OVERLAP, BATCH = 512, 0.7, 1, 5
#: Texts that a task holds as Python strings at once, and a document at least.
AT_ONCE = 4096


def estimate(text: str) -> int:
    """1.3 tokens a word, rounded up; white space at an end parts an empty word off."""
    return math.ceil(max(1, len(text.split()) + text[:1].isspace() + text[-1:].isspace()) * 1.3)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / n if n else 0.0


def chunked(sentences: list[str], embedder: Embedder, max_tokens: int = MAX_TOKENS, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> list[list[str]]:
    """A chunk ends where the next sentence is unlike its mean, or would make it too long; the next
    chunk begins with its last `overlap` sentences."""
    if len(sentences) <= 1:
        return [sentences] if sentences else []
    places = _places(np.asarray(embedder(sentences), np.float64), [*map(estimate, sentences)], max_tokens, threshold, overlap)
    return [[sentences[i] for i in c] for c in places]


def _places(vectors: np.ndarray, sizes: list[int], max_tokens: int, threshold: float, overlap: int) -> list[range]:
    """The sentences of each chunk, from their vectors and token counts. A chunk's sentences are neighbours."""
    norms = [math.sqrt(v.dot(v)) for v in vectors]
    out, first, tokens, total, length = [], 0, sizes[0], vectors[0].copy(), norms[0]
    for k in range(1, len(sizes)):
        # the mean's direction is the sum's
        n = length * norms[k]
        if (total.dot(vectors[k]) / n if n else 0.0) < threshold or tokens + sizes[k] > max_tokens:
            out.append(range(first, k))
            first = max(first, k - overlap)
            tokens, total = sum(sizes[first : k + 1]), vectors[first].copy()
            for i in range(first + 1, k + 1):
                total += vectors[i]
        else:
            tokens += sizes[k]
            total += vectors[k]
        length = math.sqrt(total.dot(total))
    return [*out, range(first, len(sizes))]


def _folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[list[str]]], list[list[tuple]]], schema: str) -> DataFrame:
    """keys and what fold() makes of each group's texts in order, as columns of schema. A group is one row, and fold() gets rows of
    AT_ONCE texts, so many small groups cost no call each."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"])
    columns, kinds = zip(*((x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.asarray(batch.column(len(keys)).offsets)[:-1]
            starts = np.flatnonzero(np.diff((before - before[:1]) // AT_ONCE, prepend=-1))
            for s, e in zip(starts, np.append(starts[1:], batch.num_rows), strict=False):
                part = batch.slice(s, e - s)
                made = fold(part.column(len(keys)).to_pylist())
                at = pa.array(np.repeat(np.arange(e - s), [len(x) for x in made]))
                found = zip(*(r for x in made for r in x), strict=True) if len(at) else [()] * len(columns)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(len(keys))), *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], names=[*keys, *columns])

    lists = rows.groupBy(*keys).agg(texts.alias("texts"))
    own = dict(lists.dtypes)
    return lists.mapInArrow(run, ", ".join([*(f"{k} {own[k]}" for k in keys), schema]))


CHUNKS = "chunk_no int, text string, start_idx int, end_idx int, token_count int, n_sentences int"


def semantic_chunks(sentences: DataFrame, embedder: Embedder | None = None, max_tokens: int = MAX_TOKENS, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """From (doc_id, seq, text): doc_id, CHUNKS. Indices are of the first place of a chunk's first and last
    sentence in the joined text."""
    embed = embedder or hashing_embedder()

    def one(own: list[str], vectors: np.ndarray) -> Iterator[tuple]:
        whole, sizes, places = " ".join(own), [*map(estimate, own)], {}

        def place(text: str) -> int:
            if text not in places:
                places[text] = whole.index(text)
            return places[text]

        for n, c in enumerate(_places(vectors, sizes, max_tokens, threshold, overlap)):
            yield n, " ".join(own[c.start : c.stop]), place(own[c.start]), place(own[c.stop - 1]) + len(own[c.stop - 1]), sum(sizes[c.start : c.stop]), len(c)

    def fold(documents: list[list[str]]) -> list[list[tuple]]:
        vectors, ends = np.asarray(embed([x for own in documents for x in own]), np.float64), np.cumsum([len(own) for own in documents])
        return [[*one(own, vectors[e - len(own) : e])] for own, e in zip(documents, ends, strict=True)]

    return _folded(sentences, ["doc_id"], ["seq"], fold, CHUNKS)


def batched_summary(chunks: list[str], summarize: Summarizer, batch: int = BATCH, attempts: int = 3, sleep: Callable[[float], None] | None = None) -> str:
    """A fold over batches: each call sees the summary so far; a batch that fails adds both its ends."""
    if len(chunks) <= 1:
        return chunks[0] if chunks else ""
    out = ""
    for s in range(0, len(chunks), batch):
        part = chunks[s : s + batch]
        prompt = "\n\n".join([*([out] if out else []), *part])
        try:
            out = with_retry(lambda prompt=prompt: summarize(prompt), attempts, 1.0, 2.0, sleep or (lambda _: None))
        except Exception:
            ends = f"{part[0][:200]}... ... {part[-1][:200] if len(part) > 1 else ''}"
            out = f"{out}\n[Chunks {s + 1}-{s + len(part)}]: {ends}".lstrip("\n")
    return out


def batched_summaries(paragraphs: DataFrame, summarize: Summarizer, batch: int = BATCH) -> DataFrame:
    """From (doc_id, rank, text): doc_id, summary."""
    return _folded(paragraphs, ["doc_id"], ["rank"], lambda documents: [[(batched_summary(own, summarize, batch),)] for own in documents], "summary string")


def page_summaries(sentences: DataFrame, summarize: Summarizer, shortest: int = 50) -> DataFrame:
    """From (doc_id, page_num, char_offset_start, id, text): doc_id, page_num, item_count, summary of pages
    of at least `shortest` characters; empty summaries go."""

    def one(own: list[str]) -> list[tuple]:
        text = "\n\n".join(own)
        made = summarize(text) if len(text) >= shortest else ""
        return [(len(own), made)] if made else []

    return _folded(sentences, ["doc_id", "page_num"], ["char_offset_start", "id"], lambda pages: [*map(one, pages)], "item_count long, summary string")
