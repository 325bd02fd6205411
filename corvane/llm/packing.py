"""5. Packing by non-negative least squares over shallow length combinations.

Texts become ids, then pieces: full windows, and one remainder shorter than a window. A full window
is a sequence of its own. For the remainders a histogram of lengths is counted over all documents
(at most WINDOW - 1 numbers). Lengths are put in bins of `quantum` tokens; combinations of two or
three bins that fill the window are enumerated, and non-negative least squares gives each a repeat
count that fits the histogram. Counts are rounded down, bins are dealt their exact lengths, and the
residual pieces are packed greedily, largest first, whole runs of equal combinations at a time.

The plan has a few thousand entries whatever the input. Each piece then needs its rank among the
pieces of its length: pieces are dealt to (length, bucket) groups of bounded size, whose counts are
summed up over buckets, so no length is ranked by one task.

Defined results: a null or empty text is one piece holding only the end id; equal rows are packed
each, and pieces of one length are dealt to sequences by digests of their rows (which of equal ones goes
where makes no difference); an empty table gives an empty table; null ids stay null.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.llm.common import A_TO_Z, batches_of, narrow, written

WINDOW = 2048
END_ID = 1
QUANTUM = 8
#: Pieces of one length in one bucket, about.
BUCKET_ROWS = 2_000
CACHE_WORDS = 250_000
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
PUNCTUATION = b".,;:!?()[]{}\"#$%&*+/=@^_`~"


# How a tokenizer must treat texts for its words to be encoded one by one.
WORD_WISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordIds(dict):
    """White-space word -> its ids as bytes, for a tokenizer whose pre-tokenizer parts texts at white
    space, lower-cases, and parts letters from punctuation. Two generations bound the memory. A tokenizer of
    another kind encodes whole texts itself."""

    def __init__(self, path: str, words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.ending: dict[str, bool] = {}
        self.tokenizer, self.words, self.old = Tokenizer.from_file(path), words, {}
        self.tokenize = self.tokenizer.model.tokenize
        own = json.loads(self.tokenizer.to_str())
        self.word_wise = all(own.get(k) == v for k, v in WORD_WISE.items())
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.bytes = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.words:
            self.old = dict(self)
            self.clear()
        if (out := self.old.get(word)) is None:
            out = self.made(word)
        self[word] = out
        return out

    def made(self, word: bytes) -> bytes:
        if b"<|" in word:  # perhaps a special token, which is case-sensitive
            return self.whole(word)
        low = word.translate(A_TO_Z)
        core = low.rstrip(PUNCTUATION)
        if core != word and core and self.ends_word(core.decode()[-1]) and b"'" not in low[len(core) :]:
            tail = low[len(core) :]
            return self[core] + (self[tail] if tail else b"")
        if PLAIN.fullmatch(text := low.decode()):  # letters in their composed form, so the model alone decides
            return np.array([t.id for t in self.tokenize(low.decode("latin-1").translate(self.bytes))], "<u4").tobytes()
        return self.whole(word)

    def ends_word(self, letter: str) -> bool:
        """Whether punctuation behind this letter is a token of its own: not where its lower-case or composed form
        ends in a mark."""
        if letter not in self.ending:
            own = self.tokenizer.normalizer.normalize_str(f"a{letter}.")
            self.ending[letter] = letter.isalpha() and self.tokenizer.pre_tokenizer.pre_tokenize_str(own)[-1][0] == "."
        return self.ending[letter]

    def whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not self.word_wise:
            return self.whole((text or "").encode())
        return b"".join([self[w] for w in text.encode().split()]) if text else b""

    def batch(self, texts: pa.Array) -> list[bytes]:
        """ids() of each text: words are numbered by Arrow, looked up once each, and gathered."""
        if not self.word_wise:
            whole = self.tokenizer.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in whole]
        texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])  # a slice's offsets then begin at 0, as ascii_lower() needs
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are case-sensitive
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        ends = np.asarray(parts.offsets)
        coded = pc.dictionary_encode(parts.flatten())
        words = pc.cast(coded.dictionary, pa.large_binary()).to_numpy(zero_copy_only=False)
        known = [self[w] if w else b"" for w in words]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        firsts = np.cumsum(sizes) - sizes
        codes = np.asarray(coded.indices)
        n = sizes[codes]
        at = np.concatenate(([0], np.cumsum(n)))
        gathered = flat[np.repeat(firsts[codes] - at[:-1], n) + np.arange(at[-1])].tobytes()
        cuts = (4 * at[ends - ends[0]]).tolist()
        return [gathered[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def slices_of(texts: pa.Array, size: int = 16 << 20):
    """(first, rows) of runs of texts of about `size` bytes, one text at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    groups = np.cumsum(lengths) // size
    for first, last in zip((b := np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(lengths)]))), b[1:], strict=False):
        if last > first:
            yield int(first), int(last - first)


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: windows of each document's ids and its remainder."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def run(batches):
        encode = word_ids(tokenizer).batch

        def rows():
            found = ((d.as_py(), ids + end) for x in batches for a, k in slices_of(x.column(1)) for d, ids in zip(x.column(0).slice(a, k), encode(x.column(1).slice(a, k)), strict=True))
            for doc_id, ids in found:
                n = len(ids) // 4
                for s in range(0, n, window):
                    own = ids[4 * s : 4 * (s + window)]
                    yield doc_id, s, len(own) // 4, zlib.crc32(own), n

        return batches_of(rows(), schema)

    return narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson and Hanson's active sets for min |A x - target|, x >= 0.

    columns: for each column of A the rows it adds one to (-1: none), so products are gathers.
    """
    n_rows, n = len(target), len(columns)
    rows = np.where(columns < 0, n_rows, columns)
    x, passive = np.zeros(n), []
    tolerance = 1e-9 * max(1.0, float(target.sum()))

    def column(k: int) -> np.ndarray:
        return np.bincount(rows[k], minlength=n_rows + 1)[:n_rows].astype(float)

    own = np.zeros((n_rows, 0))
    for _ in range(rounds or 3 * n_rows):
        residual = np.append(target - own @ x[passive], 0.0)
        gradient = residual[rows].sum(axis=1)
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= tolerance:
            break
        passive.append(best)
        own = np.column_stack((own, column(best)))
        while True:
            gram, side = own.T @ own, own.T @ target
            try:
                z = np.linalg.solve(gram, side)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(gram, side, rcond=None)[0]
            if z.min() > 0:
                x[passive] = z
                break
            at = x[passive]
            bad = z <= 0
            step = float((at[bad] / np.maximum(at[bad] - z[bad], 1e-300)).min())
            x[passive] = at + step * (z - at)
            keep = x[passive] > tolerance
            for k, good in zip(passive, keep, strict=True):
                if not good:
                    x[k] = 0.0
            passive = [k for k, good in zip(passive, keep, strict=True) if good]
            own = own[:, keep]
            if not passive:
                break
    return x


def combinations(bins: np.ndarray, full: int) -> np.ndarray:
    """Two or three of the given bins (counted from 1) that add up to `full`, as bins, -1 where unused."""
    there = np.zeros(full + 1, bool)
    there[bins] = True
    a = np.flatnonzero(there)
    a = a[a > 0]
    pairs = [(x, full - x, 0) for x in a.tolist() if x <= full - x < full and there[full - x]]
    x, y = np.meshgrid(a, a, indexing="ij")
    z = full - x - y
    ok = (x <= y) & (y <= z) & (z > 0)
    ok[ok] = there[z[ok]]
    triples = np.stack((x[ok], y[ok], z[ok]), axis=1)
    return np.concatenate((np.array(pairs, np.int64).reshape(-1, 3), triples)) - 1


def plan(histogram: dict[int, int], window: int = WINDOW, quantum: int = QUANTUM) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats): holds each length of the histogram just as often as it occurs."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    full = window // quantum
    by_bin = np.zeros(full, np.float64)
    np.add.at(by_bin, (np.arange(1, window + 1) - 1) // quantum, left[1:])
    columns = combinations(np.flatnonzero(by_bin) + 1, full)
    repeats = np.floor(nnls(columns, by_bin) + 1e-6).astype(np.int64) if len(columns) else np.zeros(0, np.int64)

    def longest(b: int) -> int:
        """The longest length of a bin that is left, 0 if none."""
        return next((k for k in range((b + 1) * quantum, b * quantum, -1) if left[k]), 0)

    for k in np.flatnonzero(repeats).tolist():
        n = int(repeats[k])
        own = [b for b in columns[k].tolist() if b >= 0]
        while n:
            lengths = []
            for b in own:
                if not (x := longest(b)):
                    break
                lengths.append(x)
                left[x] -= 1
            for x in lengths:
                left[x] += 1
            if len(lengths) < len(own):
                break
            uses = {x: lengths.count(x) for x in lengths}
            m = min(n, *(int(left[x]) // c for x, c in uses.items()))
            for x in lengths:
                left[x] -= m
            out.append((tuple(lengths), m))
            n -= m
    return out + greedy(left, window)


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of what is left, largest first; a combination repeats as often as its lengths allow."""
    from bisect import bisect_right

    left, out = left.copy(), []
    there = np.flatnonzero(left).tolist()
    while there:
        lengths, gap, used = [], window, {}
        while gap:
            k = bisect_right(there, gap) - 1
            while k >= 0 and left[there[k]] <= used.get(there[k], 0):
                k -= 1
            if k < 0:
                break
            x = there[k]
            lengths.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        m = min(int(left[x]) // c for x, c in used.items())
        for x, c in used.items():
            left[x] -= m * c
        there = [x for x in there if left[x]]
        out.append((tuple(lengths), m))
    return out


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: pieces of `length` with ranks from `first` on go to sequences from
    `sequence` on, at `offset`."""
    rows, sequence, next_rank = [], 0, {}
    for lengths, n in found:
        offset = 0
        for x in lengths:
            first = next_rank.get(x, 0)
            rows.append((x, first, sequence, offset))
            next_rank[x] = first + n
            offset += x
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {n: table[:, k] for k, n in enumerate(("length", "first", "sequence", "offset"))} | {"sequences": np.int64(sequence)}


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, quantum: int = QUANTUM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    table = written(spark, pieces(docs, tokenizer, window, end_id, id_col, text_col), "pieces")
    rest = table.filter(F.col("length") < window)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # fewer rows than the window has tokens
    where = spark.sparkContext.broadcast(slots(plan(histogram, window, quantum)))
    buckets = max(16, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets)))
    dealt = written(spark, dealt, "pieces-dealt")
    before = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("at", F.row_number().over(own) - 1).join(before, ["length", "bucket"]).select(*names, (F.col("at") + F.col("before")).alias("rank"))

    def placed(batches):
        x = where.value
        key = x["length"] << 40
        order = key + x["first"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            k = np.searchsorted(order, (length << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(x["sequence"][k] + rank - x["first"][k]), pa.array(x["offset"][k])], names=[*names, "sequence_id", "offset"])

    full = table.filter(F.col("length") == window).select(*names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(placed, ", ".join(f"{n} long" for n in (*names, "sequence_id", "offset"))).unionByName(full)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
