"""11. Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids go together.

A byte-level BPE (A) and a SentencePiece model (B) encode each text; a two-pointer merge of their cumulative
token ends cuts it into groups, within which each A token is linked to each B token. Spark then sums in how
many documents each id pair is linked, takes the largest sum of each id of either side, and joins these back.

Neither tokenizer joins anything across a single space between two other characters: A's splitter ends a
token there, and no piece of B goes on behind a space mark. So a text is a sequence of units, cut there; a
unit is encoded and merged once a block, and a text's groups are those of its units. Where a model doesn't
promise that, the whole text is the unit.

New units are encoded in runs and merged many at a time, as ends are sorted numbers on both sides.

A block is a run of documents of one task, up to UNITS different units or CHARS characters. It yields its
documents (as numbers of units), its units (as numbers of id pairs) and its id pairs with their documents.
What is shuffled are these, not a row a link: a pair that every document has comes once a block. Counts
come back to a block as one row an id pair of it.

Defined results: a text that is null, empty or whose joined token bytes aren't a space and the text has no
tokens (zeros, '' for the digest); each row is a document of its own, repeated or not, whatever its id, which
may be null; an empty table gives no rows; very long texts are a block of their own; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import narrow, written

UNITS, CHARS = 200_000, 1 << 26
#: Documents whose new units are encoded at once, and characters of them.
BATCH, BATCH_CHARS = 256, 1 << 20
SHIFT = 32
#: Units of one merge, of one run of text in it, and characters of a unit that stands in no run.
UNITS_AT_ONCE, RUN, LONG_UNIT = 16_384, 64, 1000
SPACE = "▁"
#: A space that no unit ends at stands beside other white space or at a text's end.
_ODD = re.compile("  |^ | $|[^\\S ] | [^\\S ]|᠎")
_CUT = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")

ALIGNED = "block long, kind int, at long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, xs array<int>, times array<int>, sizes array<int>"
DOCUMENT, UNIT, PAIR = 2, 1, 0


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers: ids of units, and the bytes of each id."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(k)]]
        plain = [p for k in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(k)] if not self.b.is_control(k)]
        kind = json.loads(self.a.to_str())
        splitter = kind.get("pre_tokenizer") or {}
        self.in_units = (
            kind.get("normalizer") is None
            and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
            and not any(SPACE in p.lstrip(SPACE) for p in plain)
            and self._joined("ﬁ①  x ") == " ﬁ①  x ".encode()
        )

    def _joined(self, text: str) -> bytes:
        return b"".join([self.bytes_b[k] for k in self.b.encode(text)])

    def units(self, text: str) -> list[str]:
        if not self.in_units:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def encoded(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        """A ids of a space and the unit, B ids of the unit."""
        a = self.a.encode_batch([" " + u for u in units], add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(a, self.b.encode(units, num_threads=1), strict=True)]


@cache
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Where tokens of both sides end: the merge of both lists of cumulative ends. A pointer to either side moves
    on to the first end that isn't before the other's, for all ends of a batch at once."""
    other = np.searchsorted(ends_b, ends_a)
    return ends_a[ends_b[np.minimum(other, len(ends_b) - 1)] == ends_a]


class Rows:
    """Lists of numbers under the numbers 0, 1, 2 ..., in one array that grows."""

    def __init__(self):
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate((self.flat, flat))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))

    def gathered(self, at: np.ndarray) -> np.ndarray:
        sizes = self.ends[at + 1] - self.ends[at]
        return self.flat[np.repeat(self.ends[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


#: What stands before an id in a text's groups.
FIRST, NEXT_GROUP, OTHER_SIDE, SAME_SIDE = range(4)


@cache
def _written_ids(most: int) -> list[str]:
    return [f"{mark}{k}" for mark in ("", ";", "|", ",") for k in range(most)]


def _expanded(counts: np.ndarray) -> np.ndarray:
    """0 ... n - 1 for each n of counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Block:
    """Units and id pairs of a run of documents, under numbers of its own."""

    def __init__(self, number: int, of: Tokenizers):
        self.number, self.of = number, of
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], np.int64) for side in (of.bytes_a, of.bytes_b))
        self.most = max(len(of.bytes_a), len(of.bytes_b))
        self.unit: dict[str, int] = {}
        self.texts: list[str] = []  # of each unit, its groups
        self.whole = np.zeros(0, bool)  # whether the bytes of both sides are the unit's
        self.sums = np.zeros((0, 4), np.int64)
        self.linked, self.times = Rows(), Rows()  # of each unit its id pairs, and how often each is linked
        self.pair: dict[int, int] = {}
        self.docs = np.zeros(0, np.int64)
        self.chars = 0

    def add(self, units: list[str]) -> None:
        """New units. Those that can stand in one text with others are encoded in runs."""
        plain, odd = [], []
        for u in units:
            alone = not self.of.in_units or len(u) > LONG_UNIT or u[0].isspace() or u[-1].isspace() or "᠎" in (u[0], u[-1])
            (odd if alone else plain).append(u)
        for s in range(0, len(plain), UNITS_AT_ONCE):
            self._add(plain[s : s + UNITS_AT_ONCE], RUN)
        for u in odd:
            self._add([u], 1)

    def _add(self, units: list[str], run: int) -> None:
        if not units:
            return
        runs = [units[s : s + run] for s in range(0, len(units), run)]
        encoded = self.of.encoded([" ".join(x) for x in runs])
        found = []
        for x, (a, b) in zip(runs, encoded, strict=True):
            raw = "".join([" " + u for u in x]).encode()
            whole = b"".join([self.of.bytes_a[k] for k in a]) == raw and b"".join([self.of.bytes_b[k] for k in b]) == raw
            if not whole and len(x) > 1:  # tell the units apart
                for u, own in zip(x, self.of.encoded(x), strict=True):
                    raw = (" " + u).encode()
                    found.append(([u], *own, all(b"".join([of[k] for k in ids]) == raw for of, ids in zip((self.of.bytes_a, self.of.bytes_b), own, strict=True))))
            else:
                found.append((x, a, b, whole))
        good = [x for x in found if x[3]]
        self._merged([u for x in good for u in x[0]], *(np.fromiter(chain.from_iterable([x[k] for x in good]), np.int64) for k in (1, 2)))
        for (u,), *_ in (x for x in found if not x[3]):
            self._append([u], np.zeros(1, bool), np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))

    def _merged(self, units: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Units that both sides cover, under the ids of all of them."""
        if not units:
            return
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        cuts = merged(ends_a, ends_b)
        edge = np.cumsum(np.fromiter([1 + len(u.encode()) for u in units], np.int64, len(units)))
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        unit_of = np.searchsorted(edge, cuts)  # of each group
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        of_unit = lambda x: np.bincount(unit_of, x, len(units)).astype(np.int64)
        sums = np.stack([of_unit(n_a), of_unit(n_b), np.bincount(unit_of, minlength=len(units)), of_unit(n_a * n_b)], axis=1)

        # each group's ids in order, with what stands before each
        mark_a = np.full(len(a), SAME_SIDE)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        mark_a[first_a] = np.where(np.concatenate(([True], unit_of[1:] != unit_of[:-1])), FIRST, NEXT_GROUP)
        mark_b = np.full(len(b), SAME_SIDE)
        mark_b[first_b] = OTHER_SIDE
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b[group_a]] = mark_a * self.most + a
        codes[np.arange(len(b)) + (first_a + n_a)[group_b]] = mark_b * self.most + b
        texts = _written_ids(self.most)
        pieces = [texts[k] for k in codes.tolist()]
        last = np.cumsum(sums[:, 0] + sums[:, 1]).tolist()
        written_groups = ["".join(pieces[s:e]) for s, e in zip([0, *last], last, strict=False)]

        # links: each A token with each B token of its group
        n = n_b[group_a]
        other = np.repeat(first_b[group_a], n) + _expanded(n)
        pairs, place = np.unique(np.repeat(a, n) << SHIFT | b[other], return_inverse=True)
        number = np.array([self.pair.setdefault(p, len(self.pair)) for p in pairs.tolist()], np.int64)
        of = np.repeat(unit_of[group_a], n)
        keys, times = np.unique(of << SHIFT | number[place], return_counts=True)
        self._append(units, np.ones(len(units), bool), sums, written_groups, keys & ((1 << SHIFT) - 1), times, np.bincount(keys >> SHIFT, minlength=len(units)))

    def _append(self, units, whole, sums, texts, linked, times, sizes) -> None:
        for u in units:
            self.unit[u] = len(self.unit)
        self.texts += texts
        self.whole, self.sums = np.concatenate((self.whole, whole)), np.concatenate((self.sums, sums))
        self.linked.extend(linked, sizes)
        self.times.extend(times, sizes)
        self.docs = np.concatenate((self.docs, np.zeros(len(self.pair) - len(self.docs), np.int64)))

    def joined(self, units: list[str]) -> bool:
        """Whether the joined bytes are those of the text, where those of a unit aren't."""
        ids = self.of.encoded(units)
        raw = "".join(" " + u for u in units).encode()
        return all(b"".join(of[k] for pair in ids for k in pair[side]) == raw for side, of in enumerate((self.of.bytes_a, self.of.bytes_b)))

    def document(self, doc_id, units: list[str] | None) -> tuple:
        """A row of ALIGNED; the pairs that the document links count one document more."""
        none = (self.number, DOCUMENT, None, doc_id, 0, 0, 0, 0, "", None, None, None)
        if units is None:
            return none
        own = [self.unit[u] for u in units]
        at, times = np.unique(np.array(own, np.int64), return_counts=True)
        if not self.whole[at].all():
            if len(units) == 1 or not self.joined(units):
                return none
            whole = [" ".join(units)]  # only together are the units' tokens the text's
            self.add([u for u in whole if u not in self.unit])
            return self.document(doc_id, whole)
        n = times @ self.sums[at]
        self.docs[np.unique(self.linked.gathered(at))] += 1
        digest = hashlib.sha256(";".join([self.texts[k] for k in own]).encode()).hexdigest()
        return (self.number, DOCUMENT, None, doc_id, *map(int, n), digest, at.astype(np.int32), times.astype(np.int32), None)

    def rest(self) -> Iterator[list[tuple]]:
        """Rows of its units, many a row, and of its pairs."""
        none = (None,) * 6
        ends = self.linked.ends
        for s in range(0, len(self.unit), UNITS_AT_ONCE):
            e = min(s + UNITS_AT_ONCE, len(self.unit))
            lists = slice(ends[s], ends[e])
            yield [(self.number, UNIT, s, *none, self.linked.flat[lists].astype(np.int32), self.times.flat[lists].astype(np.int32), np.diff(ends[s : e + 1]).astype(np.int32))]
        pairs = [*self.pair]
        for s in range(0, len(pairs), 65536):
            yield [(self.number, PAIR, pairs[k], None, int(self.docs[k]), k, *none[:3], None, None, None) for k in range(s, min(s + 65536, len(pairs)))]


def _aligned(byte_path: str, piece_path: str, most_units: int, most_chars: int):
    """From (doc_id, text) rows of ALIGNED. A pair's row has the pair under at, its documents under n_a, its
    number under n_b."""
    columns = [x.split()[0] for x in ALIGNED.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)), dtype=object)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, task = tokenizers(byte_path, piece_path), TaskContext.get().partitionId() << 24
        block = Block(task, of)
        held: list[tuple] = []
        chars = 0

        def out() -> Iterator[pd.DataFrame]:
            nonlocal block, chars
            new = {u: None for _, units in held for u in units or () if u not in block.unit}
            block.add([*new])
            yield frame([block.document(*x) for x in held])
            block.chars += chars
            held.clear()
            chars = 0
            if len(block.unit) >= most_units or block.chars >= most_chars:
                yield from map(frame, block.rest())
                block = Block(block.number + 1, of)

        for x in frames:
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                held.append((doc_id, of.units(text) if text else None))
                chars += len(text or "")
                if len(held) >= BATCH or chars >= BATCH_CHARS:
                    yield from out()
        if held:
            yield from out()
        yield from map(frame, block.rest())

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"


def _summed(batches) -> Iterator[pa.RecordBatch]:
    """From rows of blocks, sorted by block and kind, as ALIGNED. A
    pair's row has its number under at, its count under n_a, and under n_b and n_groups whether it is the best."""
    now = None
    value = np.zeros((0, 3), np.int64)
    own: list[np.ndarray] = []
    sums = None
    for batch in batches:
        block, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.concatenate(([0], np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(block)]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if block[a] != now:
                now, value, own, sums = block[a], np.zeros((0, 3), np.int64), [], None
            if kind[a] == PAIR:
                at = np.asarray(part.column(2))
                if at.max() >= len(value):
                    value = np.concatenate((value, np.zeros((max(len(value), int(at.max()) + 1), 3), np.int64)))
                value[at] = np.stack([np.asarray(part.column(c)) for c in (4, 5, 6)], axis=1)
            elif kind[a] == UNIT:
                # each unit's sums over its links of count, best, best_b; a row holds many units
                linked, times, sizes = (np.asarray(part.column(c).flatten()) for c in (9, 10, 11))
                total = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(value[linked] * times[:, None], axis=0)))
                edge = np.concatenate(([0], np.cumsum(sizes)))
                units = np.diff(np.asarray(part.column(11).offsets))
                number = np.repeat(np.asarray(part.column(2)), units) + _expanded(units)
                own.append(np.concatenate((number[:, None], total[edge[1:]] - total[edge[:-1]]), axis=1))
            else:
                if sums is None:
                    rows = np.concatenate(own) if own else np.zeros((0, 4), np.int64)
                    sums = np.zeros((len(rows), 3), np.int64)
                    sums[rows[:, 0]] = rows[:, 1:]
                for at in range(0, part.num_rows, BATCH):
                    docs = part.slice(at, BATCH)
                    flat, times = (np.asarray(docs.column(c).flatten()) for c in (9, 10))
                    total = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(sums[flat] * times[:, None], axis=0)))
                    edge = np.concatenate(([0], np.cumsum(np.diff(np.asarray(docs.column(9).offsets)))))
                    found = total[edge[1:]] - total[edge[:-1]]
                    ids = docs.column(3).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *(docs.column(c) for c in (4, 5, 6, 7)), pa.array(found[:, 1]), pa.array(found[:, 2]), pa.array(found[:, 0]), docs.column(8)], names=[x.split()[0] for x in RESULT.split(", ")])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, a, b, count, best_a, best_b of rows (pair, docs): in how many documents each id pair is linked, and
    whether no pair of its A id (its B id) is in more."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("a", F.shiftright("pair", SHIFT)).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    counts = written(pairs.sparkSession, counts, "pair-counts")
    # a side has as many maxima as its vocabulary has ids
    most_a, most_b = (counts.groupBy(side).agg(F.max("count").alias(f"most_{side}")) for side in "ab")
    return counts.join(most_a, "a").join(most_b, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS, chars: int = CHARS) -> DataFrame:
    """Rows of ALIGNED, written: documents, units and id pairs of each block."""
    own = narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").withColumn("doc_id", F.col("doc_id").cast("string"))
    return written(docs.sparkSession, own.mapInPandas(_aligned(byte_path, piece_path, units, chars), ALIGNED), "aligned")


def token_alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS, chars: int = CHARS) -> DataFrame:
    """RESULT of every row; n_best_b: links whose count is their B id's highest."""
    spark = docs.sparkSession
    rows = aligned(docs, byte_path, piece_path, id_col, text_col, units, chars)
    pairs = rows.filter(F.col("kind") == PAIR).select("block", F.col("at").alias("pair"), F.col("n_a").alias("docs"), F.col("n_b").alias("number"))
    counts = written(spark, pair_counts(pairs.select("pair", "docs")), "pair-best")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in ALIGNED.split(", ")[7:])]
    back = pairs.join(counts, "pair").select("block", F.lit(PAIR).alias("kind"), F.col("number").alias("at"), F.lit(None).cast("string").alias("doc_id"), F.col("count").alias("n_a"), F.col("best_a").cast("long").alias("n_b"), F.col("best_b").cast("long").alias("n_groups"), *none)
    both = rows.filter(F.col("kind") != PAIR).unionByName(back).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(_summed, RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
