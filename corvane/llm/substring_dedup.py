"""12. Substring dedup with repeated-phrase automata.

A passage of SIZE words that also starts in a document of a smaller doc_id is removed, word by word.

Texts are dealt once, by a digest, to shards of about SHARD_BYTES, in a table bucketed by shard, so that
the three passes over them move no text. Equal texts are one (the one of the smallest doc_id counts, the
others lose all their words if they hold a passage).

1. Every window has an anchor, the smallest digest of its runs of ANCHOR words, so equal windows have
   equal anchors and neighbours mostly share theirs. Anchors that stand in two texts recur.
2. Windows of recurring anchors are counted by a 128-bit digest, one row a shard and window; those that
   stand in documents of two ids are confirmed, with the first document.
3. A shard's confirmed passages are compiled to Aho-Corasick automata of at most PATTERNS each, and all
   its texts are streamed through them. A word is coded by two letters of small alphabets, so that a
   node has few branches and a match begins at a word. What the automata find is compared word by word,
   so nothing is removed for a digest's sake.

A passage that many documents hold comes to one row a shard before it is shuffled. Memory is that of a
shard, or of one text where that is longer.

Defined results: a null or empty text has no words; a null doc_id counts as the largest; rows of one doc_id
are no earlier documents of each other, repeated or not; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.llm.common import bucketed, dropped, joined_by_group, narrow, released, words_of, written

SIZE, ANCHOR = 13, 5
SHARD_BYTES = 2 << 20
#: Passages of one automaton; a shard with more of them is streamed through several.
PATTERNS = 100_000
SEED = 12
LAST = (1 << 63) - 1
#: Bytes that are hashed at once. Words over LONG bytes have a digest of their own.
BLOCK, LONG = 1 << 18, 64

_rng = np.random.default_rng(SEED)
_BYTES = _rng.integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_ODD = _rng.integers(0, 1 << 63, (3, SIZE), np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def word_digests(words: list[bytes]) -> np.ndarray:
    """A 64-bit digest of each word: a polynomial in its bytes, for a whole block of words at once."""
    line, out, at = b" ".join(words), [], 0
    while at < len(line):
        end = len(line) if len(line) - at <= BLOCK else line.rfind(b" ", at, at + BLOCK)
        if end <= at:  # one word longer than a block
            end = line.find(b" ", at)
            end = len(line) if end < 0 else end
            out.append(np.array([xxhash.xxh64_intdigest(line[at:end], SEED)], np.uint64))
        else:
            block = np.frombuffer(line, np.uint8, end - at, at)
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_BYTES[block] * _POW[: len(block)], out=sums[1:])
            gaps = np.flatnonzero(block == 32)
            starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(block)]))
            h = (sums[ends] - sums[starts]) * _INVERSE[starts]
            for k in np.flatnonzero(ends - starts > LONG):
                h[k] = xxhash.xxh64_intdigest(line[at + starts[k] : at + ends[k]], SEED)
            out.append(mixed(h))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def anchors(digests: np.ndarray) -> np.ndarray:
    """The anchor of each window, as signed longs."""
    n = len(digests) - SIZE + 1
    if n < 1:
        return np.zeros(0, np.int64)
    runs = np.zeros(len(digests) - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        runs += digests[k : k + len(runs)] * _ODD[0, k]
    least, have, want = mixed(runs), 1, SIZE - ANCHOR + 1
    while have < want:
        step = min(have, want - have)
        least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
    return least.view(np.int64)


def window_digests(digests: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for row in (1, 2):
        total = np.zeros(len(starts), np.uint64)
        for k in range(SIZE):
            total += digests[starts + k] * _ODD[row, k]
        out.append(mixed(total).view(np.int64))
    return out[0], out[1]


def _texts(table: pa.Table) -> list[tuple]:
    """(key, doc, n, text) of a shard, always in one order."""
    return sorted(zip(*(table[c].to_pylist() for c in ("key", "doc", "n", "text")), strict=True))


def _distinct(batches):
    """From (shard, key, doc, text): each text of this task once, and at its end each key's smallest doc and rows."""
    least: dict[str, list] = {}
    for batch in batches:
        new = []
        for shard, key, doc in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            new.append(key not in least)
            own = least.setdefault(key, [shard, doc, 0])
            own[1], own[2] = min(own[1], doc), own[2] + 1
        found = batch.filter(pa.array(new, pa.bool_()))
        none = pa.nulls(found.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), none, pa.array(np.zeros(found.num_rows, np.int64)), found.column(3)], names=["shard", "key", "doc", "n", "text"])
    keys, rows = [*least], [*least.values()]
    for s in range(0, len(keys), 4096):
        part = rows[s : s + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int32()), pa.array(keys[s : s + 4096]), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.nulls(len(part), pa.string())],
            names=["shard", "key", "doc", "n", "text"],
        )


def _anchors_of(table: pa.Table) -> pa.Table:
    """shard, anchor, several (whether two of the shard's texts have it)."""
    own = [np.unique(anchors(word_digests(words_of(text)))) for _, _, _, text in _texts(table)]
    found, times = np.unique(np.concatenate([*own, np.zeros(0, np.int64)]), return_counts=True)
    return pa.table({"shard": pa.array(np.full(len(found), table["shard"][0].as_py(), np.int32)), "anchor": found, "several": times > 1})


def _windows_of(texts: pa.Table, recurring: pa.Table) -> pa.Table:
    """h1, h2, shard, at, doc, last of each window of recurring anchors: where the shard has it first, in the
    document of the smallest id, and the largest id. at: the text's place in the shard, and the word's in it."""
    known = np.sort(np.asarray(recurring["anchor"]))
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for place, (_, doc, _, text) in enumerate(_texts(texts) if len(known) else []):
        digests = word_digests(words_of(text))
        own = anchors(digests)
        if not len(own):
            continue
        starts = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
        if len(starts):
            for part, x in zip(parts, (*window_digests(digests, starts), np.full(len(starts), doc), (place << 32) + starts), strict=True):
                part.append(x)
    h1, h2, doc, at = (np.concatenate(p) for p in parts)
    order = np.lexsort((at, doc, h2, h1))
    h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(h1) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.maximum.reduceat(doc, first) if len(first) else doc
    shard = texts["shard"][0].as_py() if texts.num_rows else 0
    return pa.table({"h1": h1[first], "h2": h2[first], "shard": pa.array(np.full(len(first), shard, np.int32)), "at": at[first], "doc": doc[first], "last": last})


class Automata:
    """Aho-Corasick automata of passages, given as word lists with the first document of each."""

    ALPHABET = 240
    OTHER = "\x01\x01"  # a word that no passage has

    def __init__(self, passages: list[tuple[list[bytes], int]], each: int = PATTERNS):
        self.codes: dict[bytes, str] = {}
        self.firsts = [first for _, first in passages]
        self.parts = []
        for s in range(0, len(passages), each):
            part = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, (words, _) in enumerate(passages[s : s + each], s):
                part.add_word("".join(map(self.code, words)), k)
            part.make_automaton()
            self.parts.append(part)

    def code(self, word: bytes) -> str:
        if word not in self.codes:
            high, low = divmod(len(self.codes), self.ALPHABET)
            # low letters first: few of them, and apart from the high ones, whose number grows with the words
            self.codes[word] = chr(0x100 + low) + chr(0x200 + high + 0x10000 * (high >= 0xD000))
        return self.codes[word]

    def found(self, words: list[bytes]):
        """(start, first document) of every occurrence of every passage."""
        code = self.codes.get
        line = "".join([code(w, self.OTHER) for w in words])
        for part in self.parts:
            for end, k in part.iter(line):
                yield (end + 1) // 2 - SIZE, self.firsts[k]


def _kept(texts: pa.Table, confirmed: pa.Table, patterns: int = PATTERNS) -> pa.Table:
    """key, doc, n, n_words, n_removed, kept_sha256 of each text of a shard. confirmed: at, first."""
    own = _texts(texts)
    where: dict[int, list[tuple[int, int]]] = {}
    for at, first in zip(confirmed["at"].to_pylist(), confirmed["first"].to_pylist(), strict=True):
        where.setdefault(at >> 32, []).append((at & 0xFFFFFFFF, first))
    passages = []
    for place, starts in where.items():
        words = words_of(own[place][3])
        passages += [(words[s : s + SIZE], first) for s, first in starts]
    automata = Automata(passages, patterns) if passages else None
    rows = []
    for key, doc, n, text in own:
        words = words_of(text)
        removed = 0
        if automata and len(words) >= SIZE:
            covered = np.zeros(len(words) + 1, np.int32)
            for start, first in automata.found(words):
                if first < doc:
                    covered[start] += 1
                    covered[start + SIZE] -= 1
            gone = np.cumsum(covered[:-1]) > 0
            if removed := int(gone.sum()):
                kept = [words[k] for k in np.flatnonzero(~gone)]
        rows.append((key, doc, n, len(words), removed, hashlib.sha256(b" ".join(kept if removed else words)).hexdigest()))
    names = ["key", "doc", "n", "n_words", "n_removed", "kept_sha256"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 4, pa.string()), strict=True)], names=names) if rows else pa.table([pa.array([], t) for t in (pa.string(), *[pa.int64()] * 4, pa.string())], names=names)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, patterns: int = PATTERNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    spark = docs.sparkSession
    own = narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("key", F.md5("text")).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    total, rows = own.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-(total or 0) // shard_bytes))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    once = own.select(shard, "key", "doc", "text").mapInArrow(_distinct, "shard int, key string, doc long, n long, text string")
    # the key's rows meet where the shard's do, so this makes no second exchange
    texts = once.repartition(parts, "shard").groupBy("shard", "key").agg(F.min("doc").alias("doc"), F.sum("n").alias("n"), F.first("text", ignorenulls=True).alias("text"))
    texts = bucketed(spark, texts, parts, "shard", "passage_texts")
    by = texts.groupBy("shard")

    marked = by.applyInArrow(_anchors_of, "shard int, anchor long, several boolean")
    each = W.partitionBy("anchor")
    recurring = marked.withColumn("shards", F.count(F.lit(1)).over(each)).withColumn("any", F.max("several").over(each)).filter("shards > 1 or any").select("shard", "anchor")
    recurring = written(spark, recurring, "passage-anchors")

    windows = by.cogroup(recurring.groupBy("shard")).applyInArrow(_windows_of, "h1 long, h2 long, shard int, at long, doc long, last long")
    first = F.min("doc").over(W.partitionBy("h1", "h2"))  # a passage has one row a shard
    confirmed = written(spark, windows.withColumn("first", first).filter("first < last").select("shard", "at", "first"), "passages")

    kept = by.cogroup(confirmed.groupBy("shard")).applyInArrow(lambda t, passages: _kept(t, passages, patterns), "key string, doc long, n long, n_words long, n_removed long, kept_sha256 string")
    kept = written(spark, kept, "passages-removed")
    dropped(spark, texts)
    released(spark, recurring, confirmed)
    found = joined_by_group(own.select("doc_id", F.col("doc").alias("own"), "key"), kept, "key", rows)
    copy = (F.col("own") > F.col("doc")) & (F.col("n_words") >= SIZE)
    return found.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
g AS (SELECT r, doc_id, pos, word, CASE WHEN count(*) OVER v = 13 THEN string_agg(word, ' ') OVER v END AS passage FROM x
      WINDOW v AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT passage, min(doc_id) AS first FROM g WHERE passage IS NOT NULL GROUP BY passage),
h AS (SELECT r, pos, word, coalesce((first < doc_id)::INT, 0) AS hit FROM g LEFT JOIN f USING (passage)),
c AS (SELECT r, pos, word, max(hit) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
s AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (r)
"""
