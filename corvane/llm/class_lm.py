"""8. Language-model scoring with Brown's class-based bigrams.

    P(text) = product over its tokens of P(class | class before) * P(token | class)

The CLUSTERED most frequent words are assigned to classes by exchange clustering: a word moves to the
class that raises the likelihood of the corpus' class bigrams most, until none moves. Every other word
that the training documents hold at least LEAST times is then put into the class that its own contexts
(classes before and after it, counted over the whole corpus) make likeliest: the exchange's gain, to first
order, against the classes as they stand. So the words with a class of their own grow with the corpus.
Rarer and unseen words belong to a shape class (last mark, digits, length), whose emission has an
additive floor. Transitions are counted anew over the corpus under the final classes.

Texts are tokenised twice, a part at a time: for the counts of words, and to be written as numbers of the
`head` most frequent words of training texts or of others, which go to the workers. Each occurrence of any other word is a row. These rows are
shuffled by word, so that a word's occurrences are its count and its contexts at once, and give it its class;
then by text. A word over LONGEST bytes is known by its digest, so every frequent word is in the head, and no
word outside it has more than a small share of the rows. So nothing that grows with the corpus is broadcast,
each count is exact, and the size of the head changes no score.

Defined results: a null or empty text is its end token alone; a null doc_id counts as the text ''
(crc32 0: held out); with no training document every count is 0; repeated rows are scored, and
learned from, each; of words of one count those with the smaller digests are in the head.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import A_TO_Z, batches_of, narrow, rows_of, written

#: The end token; no word holds white space.
END = b"\n"
GAP = re.compile(rb"[ \t-\r]")
HEAD_WORDS, LONGEST = 200_000, 64
CLUSTERED, CLASSES, LEAST = 2048, 64, 5
FLOOR = 0.1
BACKOFF = 5.0
FLUSH = 300_000
SHAPES = 24
#: The group of words that the head cuts is cut into so many parts.
PARTS = 4096
#: Tables of bigrams are summed up in so many tasks.
MERGERS = 8
#: Head words that are put into classes at once.
BLOCK = 4096


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


def name(word: bytes) -> bytes:
    """A word, or the digest that stands for a long one."""
    return word if len(word) <= LONGEST else b"#" + hashlib.sha256(word).hexdigest().encode()


def shape(word: bytes) -> int:
    """The class, below SHAPES, of a word that isn't clustered."""
    if word == END:
        return 0
    last = word[-1:]
    kind = 0 if last in b".!?" else 1 if last in b",;:" else 2 if any(48 <= c < 58 for c in word) else 3 if word.isalpha() else 4 if max(word) > 127 else 5
    return 4 * kind + (len(word) > 4) + (len(word) > 7) + (len(word) > 11)


def parts_of(text: str | None, size: int = 1 << 20) -> list[bytes]:
    """A text's bytes with A-Z lower-cased, cut at white space into parts of about `size`."""
    data, out, at = (text or "").encode().translate(A_TO_Z), [], 0
    while len(data) - at > size and (m := GAP.search(data, at + size)):
        out.append(data[at : m.start()])
        at = m.end()
    return [*out, data[at:]] if at else [data]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the training documents, end tokens included, and n over all; summed within partitions first."""

    def run(batches):
        def rows():
            counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())  # of training texts, of others
            flushed = lambda: ((w, n * (not held), n) for held, of in enumerate(counts) for w, n in of.items())
            for doc_id, text in rows_of(batches):
                of = counts[held_out(doc_id)]
                for part in parts_of(text):
                    of.update(part.split())
                    if sum(map(len, counts)) > FLUSH:
                        yield from flushed()
                        counts[0].clear(), counts[1].clear()
                of[END] += 1
            yield from flushed()

        return batches_of(((name(w).decode(), c, n) for w, c, n in rows()), pa.schema([("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())]))

    return docs.mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def split_head(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], DataFrame]:
    """The head: at most `most` words with their counts in training texts, the most frequent first, and the end
    token in any case; and the table of all other words. A quarter of it are the words most frequent in other
    texts of those that their training counts leave out, so no word outside the head is frequent anywhere.

    Counts are grouped by eighths of a doubling (a few hundred rows); whole groups are taken from the top
    as long as they fit. The next group is cut by its words' digests, so a flat vocabulary fills the head too.
    """
    end = F.col("word") == END.decode()
    grouped = counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)).cast("int"))

    def top(rows: DataFrame, column: str, left: int):
        """Whether a row of a count over 0 is among the first `left`."""
        size, lowest, cut = F.floor(8 * F.log2(column)).cast("int"), None, None
        short = rows.filter(F.col(column) > 0).withColumn("size", size)
        for r in sorted(short.groupBy("size").count().collect(), key=lambda r: -r["size"]):
            if r["count"] > left:
                cut = r["size"]
                break
            left, lowest = left - r["count"], r["size"]
        taken = size >= lowest if lowest is not None else F.lit(False)
        if cut is not None:
            upto = -1
            for r in sorted(short.filter(F.col("size") == cut).groupBy("part").count().collect(), key=lambda r: r["part"]):
                if r["count"] > left:
                    break
                left, upto = left - r["count"], r["part"]
            taken = taken | ((size == cut) & (F.col("part") <= upto))
        return (F.col(column) > 0) & taken

    unseen = (most - 1) // 4
    seen = top(grouped.filter(~end), "c", most - 1 - unseen)
    inside = end | seen
    inside = inside | top(grouped.filter(~inside), "n", unseen)
    found = {r["word"].encode(): r["c"] for r in grouped.filter(inside).select("word", "c").collect()}
    found.setdefault(END, 0)
    return sorted(found.items(), key=lambda x: (-x[1], x[0])), grouped.filter(~inside).select("word", "c", "n")


ENCODED = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("word", pa.string()), ("pos", pa.int64()), ("before", pa.int32()), ("after", pa.int32())]
ENCODED_SQL = "row long, doc_id long, held_out boolean, n_tokens long, ids binary, word string, pos long, before int, after int"


def encoded(docs: DataFrame, head: list[tuple[bytes, int]]) -> DataFrame:
    """A row of each text: ids, the compressed numbers of its tokens in the head, -1 - shape for others;
    and a row of each token that isn't in the head: word, pos, and the numbers before and after it."""
    sent = docs.sparkSession.sparkContext.broadcast({w: k for k, (w, _) in enumerate(head)})

    def run(batches):
        get = sent.value.get
        end, part = get(END), TaskContext.get().partitionId() << 33
        shapes: dict[bytes, int] = {}
        texts: list[list] = [[] for _ in range(5)]
        rare: list[list] = [[] for _ in range(6)]  # row, held_out, word, pos, before, after

        def made() -> pa.RecordBatch:
            n, m = len(texts[0]), len(rare[0])
            columns = [[*texts[0], *rare[0]], [*texts[1], *[None] * m], [*texts[2], *rare[1]], [*texts[3], *[None] * m], [*texts[4], *[None] * m]]
            arrays = [pa.array(c, f) for c, (_, f) in zip(columns, ENCODED[:5], strict=True)]
            arrays.append(pa.array([*[None] * n, *rare[2]], pa.binary()).cast(pa.string()))
            arrays += [pa.array([*[None] * n, *c], f) for c, (_, f) in zip(rare[3:], ENCODED[6:], strict=True)]
            for x in (*texts, *rare):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(ENCODED))

        def coded(words: list[bytes]) -> np.ndarray:
            """Numbers of words; long ones outside the head are replaced by their names."""
            ids = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
            for i in np.flatnonzero(ids < 0).tolist():
                w = words[i]
                if len(w) > LONGEST:
                    w = words[i] = name(w)
                    if (k_of := get(w)) is not None:
                        ids[i] = k_of
                        continue
                if (own := shapes.get(w)) is None:
                    if len(shapes) > FLUSH:
                        shapes.clear()
                    own = shapes[w] = shape(w)
                ids[i] = -1 - own
            return ids

        for k, (doc_id, text) in enumerate(rows_of(batches)):
            parts, held = parts_of(text), held_out(doc_id)
            words = parts[0].split()
            each = [coded(words), *(coded(x.split()) for x in parts[1:])]
            whole = np.concatenate(([end], *each, [end])).astype(np.int32)
            for x, v in zip(texts, (part + k, doc_id, held, len(whole) - 1, pa.compress(whole[1:].tobytes(), "zstd", asbytes=True)), strict=True):
                x.append(v)
            before = 0
            for data, ids in zip(parts, each, strict=True):
                at = np.flatnonzero(ids < 0)
                if len(parts) > 1 and len(at):  # the words of one part at a time
                    coded(words := data.split())
                places = at + before
                for x, v in zip(rare, ([part + k] * len(at), [held] * len(at), [words[i] for i in at.tolist()], places.tolist(), whole[places].tolist(), whole[places + 2].tolist()), strict=True):
                    x += v
                before += len(ids)
                if len(rare[0]) + len(texts[0]) > 32_768:
                    yield made()
        if texts[0] or rare[0]:
            yield made()

    return docs.mapInArrow(run, ENCODED_SQL)


def numbers(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(ids, decompressed_size=4 * n, codec="zstd"), np.int32)


def codes_of(ids: np.ndarray, of_head: np.ndarray, shapes_from: int) -> np.ndarray:
    """Of each number: its head word's code, or that of its shape."""
    return np.where(ids >= 0, of_head[ids], shapes_from - 1 - ids)


def training_runs(batches, end: int):
    """The numbers of training texts, an end token before each, joined to runs of some 4 million."""
    held, n = [np.array([end], np.int32)], 1
    for is_held, tokens, ids in rows_of(batches):
        if not is_held:
            held.append(numbers(ids, tokens))
            n += tokens
            if n > 4_000_000:
                yield np.concatenate(held)
                held, n = [np.array([end], np.int32)], 1
    if n > 1:
        yield np.concatenate(held)


def bigram_table(texts: DataFrame, of_head: np.ndarray, shapes_from: int, end: int, known_only: bool = False) -> np.ndarray:
    """Bigrams of codes over the training texts; each task sends its numbers as compressed runs.
    known_only: of two neighbours in the head alone."""
    size = shapes_from + SHAPES
    sent = texts.sparkSession.sparkContext.broadcast(of_head)

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for ids in training_runs(batches, end):
            codes = codes_of(ids, sent.value, shapes_from).astype(np.int64)
            pairs = codes[:-1] * size + codes[1:]
            total += np.bincount(pairs[(ids[:-1] >= 0) & (ids[1:] >= 0)] if known_only else pairs, minlength=size * size)
        at = np.flatnonzero(total)
        if len(at):
            runs = [zlib.compress(x.tobytes(), 1) for x in (np.diff(at, prepend=0).astype("<u4"), total[at].astype("<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in runs], names=["steps", "n"])

    return collected_table(texts.select("held_out", "n_tokens", "ids").mapInArrow(run, "steps binary, n binary"), size)


def collected_table(runs: DataFrame, size: int) -> np.ndarray:
    """The sum of tables that tasks sent. They are merged in groups of tasks before they reach the driver."""

    def merged(batches):
        total = np.zeros(size * size, np.int64)
        for _, steps, n in rows_of(batches):
            steps, n = np.frombuffer(zlib.decompress(steps), "<u4"), np.frombuffer(zlib.decompress(n), "<i8")
            total[np.cumsum(steps, dtype=np.int64)] += n
        at = np.flatnonzero(total)
        if len(at):
            packed = [zlib.compress(x.tobytes(), 1) for x in (np.diff(at, prepend=0).astype("<u4"), total[at].astype("<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["steps", "n"])

    # as a tree: to as many tasks as shuffles have, to MERGERS, to the driver
    for tasks in (max(MERGERS, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MERGERS):
        part = F.pmod(F.spark_partition_id(), F.lit(tasks)).alias("part")
        runs = runs.select(part, "steps", "n").repartition(tasks, "part").mapInArrow(merged, "steps binary, n binary")
    table = np.zeros(size * size, np.int64)
    for r in runs.collect():  # at most MERGERS tables
        steps, n = np.frombuffer(zlib.decompress(r["steps"]), "<u4"), np.frombuffer(zlib.decompress(r["n"]), "<i8")
        table[np.cumsum(steps, dtype=np.int64)] += n
    return table.reshape(size, size)


def xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1.0))


def exchange(counts: np.ndarray, n_words: int, classes: int, fixed: int, rounds: int = 8) -> np.ndarray:
    """Classes of all ids: the first n_words ids are exchanged among `classes`, the others (shapes)
    keep classes of their own. counts: bigrams of ids."""
    cls = np.concatenate((np.arange(n_words) % classes, classes + np.arange(fixed)))
    size = classes + fixed
    counts = counts.astype(np.float64)
    member = np.zeros((len(cls), size))
    member[np.arange(len(cls)), cls] = 1.0
    n = member.T @ counts @ member
    left, right = counts.sum(axis=1), counts.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for w in range(n_words):
            own = cls[w]
            out = np.bincount(cls, weights=counts[w], minlength=size)
            into = np.bincount(cls, weights=counts[:, w], minlength=size)
            both = counts[w, w]
            out[own] -= both
            into[own] -= both
            n[own] -= out
            n[:, own] -= into
            n[own, own] -= both
            rows, columns = n[:classes], n[:, :classes].T
            gain = (xlogx(rows + out) - xlogx(rows)).sum(axis=1) + (xlogx(columns + into) - xlogx(columns)).sum(axis=1)
            d = np.arange(classes)
            diagonal = n[d, d]
            gain += xlogx(diagonal + out[:classes] + into[:classes] + both) - xlogx(diagonal + out[:classes]) - xlogx(diagonal + into[:classes]) + xlogx(diagonal)
            a, b = rows.sum(axis=1), columns.sum(axis=1)
            gain -= xlogx(a + left[w]) - xlogx(a) + xlogx(b + right[w]) - xlogx(b)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            cls[w] = best
            moved += best != own
            n[best] += out
            n[:, best] += into
            n[best, best] += both
        if not moved:
            break
    return cls


def likeliest(left: np.ndarray, right: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class (below `classes`) of each word from its counts of classes before (left) and after (right) it,
    given the bigrams of classes: the gain in likelihood of putting it there, to first order."""
    n = table.astype(np.float64) + 0.1
    after, before = np.log(n[:classes]), np.log(n[:, :classes])
    gain = right @ after.T + left @ before
    gain -= right.sum(axis=1, keepdims=True) * np.log(n[:classes].sum(axis=1)) + left.sum(axis=1, keepdims=True) * np.log(n[:, :classes].sum(axis=0))
    return gain.argmax(axis=1)


def head_classes(texts: DataFrame, of_head: np.ndarray, first: int, table: np.ndarray, classes: int, end: int) -> np.ndarray:
    """The likeliest class of each head word from the place `first` on. Contexts are counted in each task and
    sent as compressed runs, by blocks of words."""
    size = len(table)
    sent = texts.sparkSession.sparkContext.broadcast((of_head, table))

    def contexts(batches):
        of, _ = sent.value
        for ids in training_runs(batches, end):
            codes = codes_of(ids, of, classes).astype(np.int64)
            mine = ids >= first
            left, right = np.flatnonzero(mine[1:]) + 1, np.flatnonzero(mine[:-1])
            keys = np.concatenate(((ids[left].astype(np.int64) - first) * 2 * size + codes[left - 1], (ids[right].astype(np.int64) - first) * 2 * size + size + codes[right + 1]))
            keys, n = np.unique(keys, return_counts=True)
            block = keys // (2 * size * BLOCK)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(keys)]))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield packed(int(block[a]), keys[a:b] - block[a] * 2 * size * BLOCK, n[a:b])

    def summed(finish):
        """Of rows (block, keys, n) in order of blocks: finish() of each block's sum."""

        def run(batches):
            now, total = None, None
            for block, keys, n in rows_of(batches):
                if block != now:
                    if now is not None:
                        yield finish(now, total)
                    now, total = block, np.zeros(BLOCK * 2 * size)
                total[np.frombuffer(zlib.decompress(keys), "<u4")] += np.frombuffer(zlib.decompress(n), "<u4")
            if now is not None:
                yield finish(now, total)

        return run

    def packed(block: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([zlib.compress(x.astype("<u4").tobytes(), 1)], pa.binary()) for x in (keys, n))], names=["block", "keys", "n"])

    def sparse(block: int, total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return packed(block, at, total[at])

    def assigned(block: int, total: np.ndarray) -> pa.RecordBatch:
        own = total.reshape(BLOCK, 2, size)
        used = np.flatnonzero(own.any(axis=(1, 2)))
        best = likeliest(own[used, 0], own[used, 1], sent.value[1], classes)
        return pa.RecordBatch.from_arrays([pa.array(first + block * BLOCK + used, pa.int64()), pa.array(best, pa.int64())], names=["id", "class"])

    runs = texts.select("held_out", "n_tokens", "ids").mapInArrow(contexts, "block int, keys binary, n binary")
    # as a tree: each block's runs in parts, then its parts
    parts = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    runs = runs.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).repartition("block", "part").sortWithinPartitions("block", "part").select("block", "keys", "n").mapInArrow(summed(sparse), "block int, keys binary, n binary")
    found = runs.repartition("block").sortWithinPartitions("block").mapInArrow(summed(assigned), "id long, class long").collect()  # of head words only
    out = of_head.copy()
    for r in found:
        out[r["id"]] = r["class"]
    return out


OTHERS = "word string, row long, pos long, held_out boolean, before int, after int, c long, class long, first boolean"


def other_classes(rare: DataFrame, of_head: np.ndarray, table: np.ndarray, classes: int, least: int) -> DataFrame:
    """The rows of tokens outside the head with their word's count c in training texts and its class: the
    likeliest if it is held `least` times, else its shape's. first: one training row of each word."""
    size = len(table)
    sent = rare.sparkSession.sparkContext.broadcast((of_head, table))
    columns = ["word", "row", "pos", "held_out", "before", "after"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            of, table = sent.value
            rows = rows.combine_chunks()
            coded = rows.column(0).dictionary_encode().combine_chunks()
            g, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
            train = ~np.asarray(rows.column(3))
            c = np.bincount(g[train], minlength=len(names))
            cls = np.array([classes + shape(w.encode()) for w in names], np.int64)
            often = np.flatnonzero(c >= least)
            place = np.full(len(names), -1)
            place[often] = np.arange(len(often))
            mine = np.flatnonzero(train & (place[g] >= 0))
            left, right = (np.bincount(place[g[mine]] * size + codes_of(np.asarray(rows.column(k))[mine], of, classes), minlength=len(often) * size).reshape(-1, size) for k in (4, 5))
            if len(often):
                cls[often] = likeliest(left, right, table, classes)
            first = np.zeros(len(g), bool)
            at = np.flatnonzero(train)
            first[at[np.unique(g[at], return_index=True)[1]]] = True
            out = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in rows.columns]
            return pa.RecordBatch.from_arrays([*out, pa.array(c[g]), pa.array(cls[g]), pa.array(first)], names=[*columns, "c", "class", "first"])

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n > 30_000:  # whole words: all but the last one's rows
                rows = pa.Table.from_batches(held)
                last = rows.column(0)[-1]
                ends = int(pc.index(rows.column(0), last).as_py())
                if ends:
                    yield made(rows.slice(0, ends))
                held = rows.slice(ends).to_batches()
                n = len(rows) - ends
                if not ends:
                    n = 0  # one word fills what is held: it goes on
        if held:
            yield made(pa.Table.from_batches(held))

    return rare.select(*columns).repartition("word").sortWithinPartitions("word").mapInArrow(run, OTHERS)


@dataclass(frozen=True)
class Model:
    """Bounded by its parameters; words outside the head stay in a table."""

    head: list  # (word, count)
    classes: np.ndarray  # by place in head
    emission: np.ndarray  # log10 by place in head
    transition: np.ndarray  # log10 by class before and class
    class_tokens: np.ndarray  # tokens of each class' own words, over the whole vocabulary
    class_words: np.ndarray
    own_classes: int  # those before the shapes'
    train_tokens: int
    vocabulary: int

    @property
    def floor(self) -> float:
        return self.train_tokens + 0.1 * (self.vocabulary + 1)


@dataclass(frozen=True)
class Trained:
    model: Model
    words: DataFrame  # OTHERS of all tokens outside the head
    texts: DataFrame  # encoded() rows of texts
    resolved: DataFrame  # each token outside the head: RESOLVED


RESOLVED = "row long, held_out boolean, class_before long, class long, class_after long, c long, first boolean"


def resolved_tokens(tokens: DataFrame, of_head: np.ndarray) -> DataFrame:
    """Each token outside the head with its class and its neighbours' (-1: one after it that isn't in the head)."""
    sent = tokens.sparkSession.sparkContext.broadcast(of_head)

    def run(batches):
        last = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            before, after, cls = (np.asarray(batch.column(k)).astype(np.int64) for k in (3, 4, 6))
            # where the token before isn't in the head it is the row before
            prior = np.concatenate(([last], cls[:-1]))
            left = np.where(before >= 0, sent.value[np.maximum(before, 0)], prior)
            right = np.where(after >= 0, sent.value[np.maximum(after, 0)], -1)
            last = int(cls[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(left, pa.int64()), batch.column(6), pa.array(right, pa.int64()), batch.column(5), batch.column(7)], names=["row", "held_out", "class_before", "class", "class_after", "c", "first"])

    own = tokens.select("row", "pos", "held_out", "before", "after", "c", "class", "first")
    return own.repartition("row").sortWithinPartitions("row", "pos").mapInArrow(run, RESOLVED)


def trained(docs: DataFrame, head_words: int = HEAD_WORDS, clustered: int = CLUSTERED, classes: int = CLASSES, least: int = LEAST) -> Trained:
    """The model, and the texts as numbers. docs: doc_id, text."""
    spark = docs.sparkSession
    counts = written(spark, word_counts(docs), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    head, _ = split_head(counts, head_words)
    both = written(spark, encoded(docs, head), "lm-tokens")
    texts, rare = both.filter("ids is not null"), both.filter("word is not null")
    number, shapes = np.array([c for _, c in head], np.int64), np.array([shape(w) for w, _ in head], np.int64)
    end = next(i for i, (w, _) in enumerate(head) if w == END)
    k = min(clustered, int((number > 0).sum()))
    size, classes = k + SHAPES, max(1, min(classes, k))

    # exchange of the most frequent words, the others standing for their shapes
    table = bigram_table(texts, np.where(np.arange(len(head)) < k, np.arange(len(head)), k + shapes), k, end)
    cls = exchange(table, k, classes, SHAPES)
    member = np.zeros((size, classes + SHAPES))
    member[np.arange(size), cls] = 1.0
    of_head = np.concatenate((cls[:k], classes + shapes[k:]))
    by_class = member.T @ table @ member

    # all other words held often enough, given those classes
    found = head_classes(texts, of_head, k, by_class, classes, end)
    final = np.where((np.arange(len(head)) >= k) & (number >= least), found, of_head)
    words = other_classes(rare, of_head, by_class, classes, least)
    resolved = written(spark, resolved_tokens(words, final), "lm-resolved")

    # transitions under the final classes: neighbours in the head, then all others
    groups = classes + SHAPES
    n = bigram_table(texts, final, classes, end, known_only=True)

    # its last two rows hold, of each class, the tokens and the words outside the head
    wide = groups + 2

    def pairs(batches):
        seen = np.zeros(wide * wide, np.int64)
        for batch in batches:
            left, own, right, first = (np.asarray(batch.column(x)) for x in range(4))
            for x in (left * wide + own, (own * wide + right)[right >= 0], groups * wide + own, (groups + 1) * wide + own[first]):
                seen += np.bincount(x, minlength=wide * wide)
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (np.diff(at, prepend=0).astype("<u4"), seen[at].astype("<i8"))], names=["steps", "n"])

    more = collected_table(resolved.filter("not held_out").select("class_before", "class", "class_after", "first").mapInArrow(pairs, "steps binary, n binary"), wide)
    n = n + more[:groups, :groups]
    of = n.sum(axis=0)
    prior = (of + 0.5) / (of.sum() + 0.5 * groups)
    transition = np.log10((n + BACKOFF * prior) / (n.sum(axis=1, keepdims=True) + BACKOFF))

    # tokens and words of each class, over the whole vocabulary
    tokens, kind = (np.bincount(final, weights=x, minlength=groups) + y[:groups] for x, y in zip((number, number > 0), more[groups:], strict=True))
    emission = emitted(number, final, tokens, kind, classes)
    return Trained(Model(head, final, emission, transition, tokens, kind, classes, int(total), int(kinds)), words, texts, resolved)


def emitted(c: np.ndarray, cls: np.ndarray, tokens: np.ndarray, words: np.ndarray, classes: int) -> np.ndarray:
    """log10 P(token | class): a word's share of its class; in a shape class with a floor for unseen words."""
    share = np.maximum(c, 1e-300) / np.maximum(tokens[cls], 1e-300)
    return np.where(cls < classes, np.log10(share), np.log10((c + FLOOR) / (tokens[cls] + FLOOR * (words[cls] + 1))))


def scores(of: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    sent, m = of.texts.sparkSession.sparkContext.broadcast(of.model), of.model

    def known(batches):
        m = sent.value
        number = np.array([c for _, c in m.head], np.float64)
        base = np.append(np.log10((number + 0.1) / m.floor), 0.0)
        emission, cls, seen = np.append(m.emission, 0.0), np.append(m.classes, 0), np.append(number > 0, False)
        before = m.classes[next(i for i, (w, _) in enumerate(m.head) if w == END)]
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

        def rows():
            for row, doc_id, held, n, packed in rows_of(batches):
                ids = np.maximum(numbers(packed, n), -1)
                own = cls[ids]
                steps = m.transition[np.concatenate(([before], own[:-1])), own]
                both = (ids >= 0) & np.concatenate(([True], ids[:-1] >= 0))
                yield row, doc_id, held, n, int(seen[ids].sum()), float(base[ids].sum()), float(steps[both].sum() + emission[ids].sum())

        return batches_of(rows(), schema)

    def others(batches):
        m = sent.value
        for batch in batches:
            row, left, own, right, c = (np.asarray(batch.column(k)) for k in range(5))
            score = m.transition[left, own] + np.where(right >= 0, m.transition[own, right], 0.0) + emitted(c, own, m.class_tokens, m.class_words, m.own_classes)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10((c + 0.1) / m.floor), score)]
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), *map(pa.array, sums)], names=["row", "more_n_known", "more_base", "more_score"])

    docs = of.texts.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(known, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    parts = of.resolved.select("row", "class_before", "class", "class_after", "c").mapInArrow(others, "row long, more_n_known long, more_base double, more_score double")
    more = parts.groupBy("row").agg(*(F.sum(x).alias(x) for x in ("more_n_known", "more_base", "more_score")))
    plus = lambda x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0))
    return docs.join(more, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known").cast("long").alias("n_known"), F.lit(m.train_tokens).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("score").alias("score"))


def class_lm(docs: DataFrame, head_words: int = HEAD_WORDS, clustered: int = CLUSTERED, classes: int = CLASSES, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, model and scores over the whole table."""
    return scores(trained(narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string"), head_words, clustered, classes, least))


def perplexity(log10_probability: float, tokens: int) -> float:
    return 10 ** (-log10_probability / tokens) if tokens else math.inf


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm(spark.read.parquet(f"{sf_dir}/documents.parquet"))
