"""3. Quality rules as a short-circuit cascade.

Each rule reads features of a text; a feature is computed when a rule first asks for it. On a bounded
sample every rule's cost (seconds) and selectivity (texts that it rejects) are measured; the cascade
then runs the rules in falling order of rejections per second and stops at the first that rejects.
The order changes only the cost: a text is kept if no rule rejects it.

Defined results: a null or empty text has no words, so it fails the base; equal rows get equal
results; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, batches_of, narrow, rows_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: The longest text of the sample on which rules are measured.
SAMPLE_CHARS = 50_000
#: Odd multipliers of the window hash; equal hashes are compared word by word.
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words which the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    hashes = np.zeros(n, np.uint64)
    for k in range(size):
        hashes += ids[k : k + n] * MULTIPLIERS[k]
    ordered = np.sort(hashes)
    twice = ordered[1:] == ordered[:-1]
    if not twice.any():
        return 0
    repeated = np.unique(ordered[1:][twice])
    at = np.flatnonzero(np.isin(hashes, repeated))
    windows = np.lib.stride_tricks.sliding_window_view(ids, size)[at]
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.reshape(-1)] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Features:
    """What rules can ask of a text."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: The base rules of the contract, then rules in the manner of the published web-text filters.
BASE = (
    Rule("few_words", lambda x: x.n_words < 20),
    Rule("repeated_windows", lambda x: 100 * x.n_repeat_words > 30 * x.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda x: 10 * x.n_symbols > x.n_words),
    Rule("duplicate_lines", lambda x: 2 * x.n_dup_lines > len(x.lines)),
    Rule("word_length", lambda x: x.word_chars < 2 * x.n_words or x.word_chars > 15 * x.n_words),
    Rule("capitals", lambda x: 2 * x.n_upper > x.word_chars),
)


def measured(texts: list[str | None], rules: tuple[Rule, ...]) -> list[tuple[int, float]]:
    """Of each rule: texts that it rejects, seconds."""
    out = []
    for rule in rules:
        features = [Features(t) for t in texts]
        began = time.perf_counter()
        out.append((sum(rule.rejects(x) for x in features), time.perf_counter() - began))
    return out


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> list[int]:
    """Positions of the rules, most rejections per second first (ties: as given).

    The sample is bounded in rows and in characters, and read from as few partitions as hold it.
    """
    texts = [r["text"] for r in docs.select("text").filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).take(sample_rows)]
    rate = [rejected / max(seconds, 1e-9) for rejected, seconds in measured(texts, rules)]
    return sorted(range(len(rules)), key=lambda k: (-rate[k], k))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, counts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts (if asked for), base_failed and kept of every row."""
    own = narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    cascade = [rules[k] for k in ordered(own, rules, sample_rows)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if counts else ()
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text in rows_of(batches):
                x = Features(text)
                failed = next((r.name for r in cascade if r.rejects(x)), None)
                base = failed in {r.name for r in BASE} or any(r.rejects(x) for r in BASE)
                yield doc_id, *(getattr(x, n) for n in names), base, not base and failed is None

        return batches_of(rows(), schema)

    return own.mapInArrow(run, "doc_id long, " + "".join(f"{n} long, " for n in names) + "base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns, in one pass and without a shuffle."""
    cascade = [rules[k] for k in ordered(narrow(docs, text=f"{text_col}:string"), rules, sample_rows)]
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            keep = [not any(r.rejects(x) for r in cascade) for x in (Features(texts[i].as_py()) for i in range(batch.num_rows))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
g AS (SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram,
        count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w),
r AS (SELECT doc_id, pos, (n = 8 AND count(*) OVER (PARTITION BY doc_id, n, gram) > 1)::INT AS twice FROM g),
c AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM r),
s AS (SELECT doc_id, sum(covered)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
f AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM t LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > word_chars) AS kept
FROM b
"""
