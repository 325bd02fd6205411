"""10. SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A document up to GIANT characters is encoded whole by the library. A longer one is normalised and cut
into chunks of CHUNK characters, wherever that falls, which are dealt out. At a chunk's boundary the
state is the piece that lies across it (or ends there). Each chunk yields a matrix: the best score from
each state at its start to each state at its end. The matrices multiply in the max-plus semiring; as
that is associative, their prefix and suffix products come from a doubling scan, and the best state at
each boundary from their sum. Each chunk is then backtraced on its own between its two states.

No piece spans two words (a model with one that does is scanned without this), so within a chunk every
path passes each word start, and the chunk's matrix is a product: from its entry states to the first word
start, the words between, each a 1x1 matrix that is remembered by word, and from the last word start to
its exit states. Ids of giant documents come from these lattices alone.

Scores. In a unigram model a piece adds its own score. In a BPE model a segmentation is that of the
merges just if each two neighbours, merged alone, stay the two of them; so a step scores 0 if they
do and minus infinity if not, and just one path is left.

Defined results: a null or empty text has no ids; characters that no piece holds become byte pieces;
repeated rows are encoded each; null ids stay null; round_trip tells whether the decoded ids are the
given text (a literal space mark comes back as a space, so it is false then), at any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import batches_of, narrow, rows_of, written

GIANT, CHUNK = 1 << 16, 1 << 15
SPACE = "▁"
#: The state of a boundary between two words, and of a text's ends: (characters before it, piece).
CUT = (0, "")


class Pieces:
    """A SentencePiece model: the library's processor, and its pieces for the lattice."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        self.sp, self.kind = sentencepiece.SentencePieceProcessor(model_file=path), kind
        n = self.sp.get_piece_size()
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i) for i in range(n)]
        self.ids = {self.sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [b""] * n
        for i in range(n):
            if self.sp.is_byte(i):
                self.bytes[i] = bytes([int(self.sp.id_to_piece(i)[3:5], 16)])
            elif not self.sp.is_control(i):
                self.bytes[i] = self.sp.id_to_piece(i).encode()
        self.byte_ids = {self.bytes[i][0]: i for i in range(n) if self.sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.unknown_score = min(self.scores.values()) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[float, list[str]]] = {}
        self.one_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def word(self, text: str) -> tuple[float, list[str]]:
        """The best path through a whole word: its score and pieces. Short words are remembered."""
        if (found := self.words.get(text)) is None:
            best = forward(self, text, 0, len(text), [CUT])[len(text)]
            found = max(of[0][0] for of in best.values()), path(self, text, 0, len(text), CUT, CUT)
            if len(text) <= 64:
                if len(self.words) > 200_000:
                    self.words.clear()
                self.words[text] = found
        return found

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def step(self, before: str, piece: str) -> float | None:
        """The score of a piece after another one ('': after a cut); None if it can't follow."""
        if self.kind != "bpe":
            return self.scores.get(piece, self.unknown_score)
        key = (before, piece)
        if (fits := self.pairs.get(key)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            fits = self.pairs[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return 0.0 if fits else None

    def at(self, text: str, start: int) -> list[str]:
        """Pieces that begin at a place; a character that no piece is stands for itself."""
        out, end = [], start + 1
        while end <= len(text) and (p := text[start:end]) in self.prefixes:
            if p in self.ids:
                out.append(p)
            end += 1
        if text[start] not in self.ids:
            out.append(text[start])
        return out

    def id_list(self, pieces: Iterable[str]) -> list[int]:
        return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode()])]

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(self.sp.encode(text) if text else [], "<u4")

    def normal(self, text: str) -> str:
        return self.sp.normalize(text)

    def spelled(self, ids: np.ndarray) -> str:
        """The normalised text of some ids."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode(errors="replace")

    def decode(self, ids: np.ndarray) -> str:
        return self.spelled(ids).replace(SPACE, " ").removeprefix(" ")


@cache
def pieces_of(path: str, kind: str = "bpe") -> Pieces:
    return Pieces(path, kind)


def is_cut(model: Pieces, text: str, at: int) -> bool:
    """Whether no piece can lie across this place."""
    return at in (0, len(text)) or (model.one_word and text[at] == SPACE and text[at - 1] != SPACE)


def boundaries(text: str, chunk: int = CHUNK) -> list[int]:
    return [*range(0, len(text), chunk), len(text)] if text else [0, 0]


def word_starts(model: Pieces, text: str, start: int, end: int, cuts: tuple[bool, bool]) -> list[int]:
    """The places of [start, end] that no piece lies across."""
    inner = [k for k in range(start + 1, end) if text[k] == SPACE and text[k - 1] != SPACE] if model.one_word else []
    return [*([start] if cuts[0] else []), *inner, *([end] if cuts[1] and end > start else [])]


def states_at(model: Pieces, text: str, at: int, cut: bool) -> list[tuple[int, str]]:
    """States of a boundary: (characters of the piece before it, the piece)."""
    if cut:
        return [CUT]
    return [(at - s, p) for s in range(max(0, at - model.longest), at) for p in model.at(text, s) if s + len(p) >= at and model.step("", p) is not None]


def forward(model: Pieces, text: str, start: int, end: int, entries: list[tuple[int, str]]):
    """best[place][piece that ends there] = {entry: (score, piece before)}, from each entry on."""
    best: dict[int, dict[str, dict[int, tuple[float, str]]]] = {}
    for k, (before, piece) in enumerate(entries):
        best.setdefault(start - before + len(piece), {}).setdefault(piece, {})[k] = (0.0, "")
    merge = model.kind != "bpe"
    for at in range(start, end):
        if at not in best:
            continue
        here = best[at]
        if merge and len(here) > 1:  # the piece before doesn't matter: only the best of each entry goes on
            top: dict[int, tuple[float, str]] = {}
            for p, of in here.items():
                for k, (s, _) in of.items():
                    if k not in top or s > top[k][0]:
                        top[k] = (s, p)
            sources = {p: {k: v for k, v in of.items() if top[k][1] == p} for p, of in here.items()}
        else:
            sources = here
        for piece in model.at(text, at):
            for p, of in sources.items():
                if of and (s := model.step(p, piece)) is not None:
                    into = best.setdefault(at + len(piece), {}).setdefault(piece, {})
                    for k, (score, _) in of.items():
                        if k not in into or score + s > into[k][0]:
                            into[k] = (score + s, p)
    return best


def exit_place(end: int, state: tuple[int, str]) -> int:
    return end - state[0] + len(state[1])


def between(model: Pieces, text: str, start: int, end: int, entries: list, exits: list) -> np.ndarray:
    """Best scores from each entry state at start to each exit state at end, through the whole lattice."""
    out = np.full((len(entries), len(exits)), -np.inf)
    best = forward(model, text, start, end, entries)
    for j, state in enumerate(exits):
        for piece, of in best.get(exit_place(end, state), {}).items():
            if state == CUT or piece == state[1]:
                for k, (s, _) in of.items():
                    out[k, j] = max(out[k, j], s)
    for k, (before, piece) in enumerate(entries):  # one piece lies across both ends
        for j, state in enumerate(exits):
            if piece and piece == state[1] and start - before == end - state[0]:
                out[k, j] = 0.0
    return out


def matrix(model: Pieces, text: str, start: int, end: int, cuts: tuple[bool, bool]) -> tuple[list, list, np.ndarray]:
    """States at the start, states at the end, best scores between them."""
    entries, exits = states_at(model, text, start, cuts[0]), states_at(model, text, end, cuts[1])
    at = word_starts(model, text, start, end, cuts)
    if not at:
        return entries, exits, between(model, text, start, end, entries, exits)
    words = sum(model.word(text[a:b])[0] for a, b in zip(at, at[1:], strict=False))
    head = between(model, text, start, at[0], entries, [CUT]) if at[0] > start else np.zeros((1, 1))
    tail = between(model, text, at[-1], end, [CUT], exits) if at[-1] < end else np.zeros((1, 1))
    return entries, exits, times(head + words, tail)


def path(model: Pieces, text: str, start: int, end: int, entry: tuple[int, str], leave: tuple[int, str]) -> list[str]:
    """The pieces after the entry state's up to the exit state's."""
    first, at = start - entry[0] + len(entry[1]), exit_place(end, leave)
    if at <= first:
        return []
    best = forward(model, text, start, end, [entry])
    piece = leave[1] or max(best[at], key=lambda p: best[at][p][0][0])
    out = []
    while at > first:
        out.append(piece)
        before = best[at][piece][0][1]
        at -= len(piece)
        if at > first and model.kind != "bpe":
            before = max(best[at], key=lambda p: best[at][p][0][0])
        piece = before
    return out[::-1]


def backtrace(model: Pieces, text: str, start: int, end: int, cuts: tuple[bool, bool], entry: tuple[int, str], leave: tuple[int, str]) -> np.ndarray:
    """Ids of the pieces after the entry state's up to the exit state's."""
    at = word_starts(model, text, start, end, cuts)
    if not at:
        return np.array(model.id_list(path(model, text, start, end, entry, leave)), "<u4")
    out = path(model, text, start, at[0], entry, CUT) if at[0] > start else []
    for a, b in zip(at, at[1:], strict=False):
        out += model.word(text[a:b])[1]
    out += path(model, text, at[-1], end, CUT, leave) if at[-1] < end else []
    return np.array(model.id_list(out), "<u4")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Prefix products, by doubling: as many steps as the logarithm of their number."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [out[k] if k < step else times(out[k - step], out[k]) for k in range(len(out))]
        step *= 2
    return out


def chosen(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary, first and last included, on the best path."""
    before = scan(matrices)
    after = [m.T for m in scan([m.T for m in reversed(matrices)])][::-1]
    inner = [int((a.max(axis=0) + b.max(axis=1)).argmax()) for a, b in zip(before, after[1:], strict=False)]
    return [0, *inner, 0]


def crc_combined(parts: Iterable[tuple[int, int]]) -> int:
    """The CRC-32 of joined byte strings from (crc, bytes) of each."""

    def product(a: int, b: int) -> int:  # of polynomials, reflected, modulo the CRC's
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    out = 0
    for crc, n in parts:
        power, base, e = 0x80000000, 0x00800000, n  # x ** 0 and x ** 8
        while e:
            if e & 1:
                power = product(power, base)
            base = product(base, base)
            e >>= 1
        out = product(out, power) ^ crc
    return out


RESULT = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def _chunk_rows(path: str, kind: str, chunk: int):
    """Chunks with as much text on each side as a piece can reach."""

    def run(batches):
        model, part = pieces_of(path, kind), TaskContext.get().partitionId() << 33

        def rows():
            for n, (doc_id, text) in enumerate(rows_of(batches)):
                normal = model.normal(text)
                same = normal.replace(SPACE, " ").removeprefix(" ") == text
                places = boundaries(normal, chunk)
                for k, (s, e) in enumerate(zip(places, places[1:], strict=False)):
                    a, b = max(0, s - model.longest), min(len(normal), e + model.longest)
                    yield part + n, doc_id, k, normal[a:b], s - a, e - a, is_cut(model, normal, s), is_cut(model, normal, e), same

        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cut_start", pa.bool_()), ("cut_end", pa.bool_()), ("same", pa.bool_())])
        return batches_of(rows(), schema, 64)

    return run


CHUNKS = "row long, doc_id long, chunk int, text string, start long, end long, cut_start boolean, cut_end boolean, same boolean"


def _matrices(path: str, kind: str):
    def run(batches):
        model = pieces_of(path, kind)

        def rows():
            for row, chunk, text, start, end, a, b in rows_of(batches):
                entries, exits, m = matrix(model, text, start, end, (a, b))
                yield row, chunk, len(entries), len(exits), m.reshape(-1).tolist(), [x for x, _ in exits], [p for _, p in exits]

        schema = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("n_in", pa.int32()), ("n_out", pa.int32()), ("scores", pa.list_(pa.float64())), ("out_before", pa.list_(pa.int64())), ("out_piece", pa.list_(pa.string()))])
        return batches_of(rows(), schema, 64)

    return run


def _states(group: pd.DataFrame) -> pd.DataFrame:
    """The states on the best path of one document: at most 2 GB of text, so 65,536 small matrices."""
    group = group.sort_values("chunk")
    path = chosen([np.array(s, float).reshape(a, b) for s, a, b in zip(group["scores"], group["n_in"], group["n_out"], strict=True)])
    ends = [(int(x[k]), p[k]) for x, p, k in zip(group["out_before"], group["out_piece"], path[1:], strict=True)]
    starts = [CUT, *ends[:-1]]
    return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "in_before": [a for a, _ in starts], "in_piece": [p for _, p in starts], "out_before": [a for a, _ in ends], "out_piece": [p for _, p in ends]})


def giant_ids(docs: DataFrame, path: str, kind: str = "bpe", chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, chunk, ids, n_ids, ids_crc32, round_trip of each chunk of the given (doc_id, text)."""
    spark = docs.sparkSession
    chunks = written(spark, docs.mapInArrow(_chunk_rows(path, kind, chunk), CHUNKS), "giant-chunks")
    dealt = chunks.select("row", "chunk", "text", "start", "end", "cut_start", "cut_end").repartition("row", "chunk")
    found = dealt.mapInArrow(_matrices(path, kind), "row long, chunk int, n_in int, n_out int, scores array<double>, out_before array<long>, out_piece array<string>")
    states = found.groupBy("row").applyInPandas(_states, "row long, chunk int, in_before long, in_piece string, out_before long, out_piece string")

    def traced(batches):
        model = pieces_of(path, kind)

        def rows():
            for row, chunk, doc_id, text, start, end, a, b, same, in_before, in_piece, out_before, out_piece in rows_of(batches):
                entry, leave = (in_before, in_piece), (out_before, out_piece)
                ids = backtrace(model, text, start, end, (a, b), entry, leave)
                own = text[start - in_before + len(in_piece) : exit_place(end, leave)]
                yield row, doc_id, chunk, ids.tolist(), len(ids), zlib.crc32(ids.tobytes()), same and model.spelled(ids) == own

        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
        return batches_of(rows(), schema, 16)

    return chunks.join(states, ["row", "chunk"]).select("row", "chunk", "doc_id", "text", "start", "end", "cut_start", "cut_end", "same", "in_before", "in_piece", "out_before", "out_piece").mapInArrow(traced, "row long, doc_id long, chunk int, ids array<long>, n_ids long, ids_crc32 long, round_trip boolean")


def _combined(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk")
    crc = crc_combined((int(c), 4 * int(n)) for c, n in zip(group["ids_crc32"], group["n_ids"], strict=True))
    return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "n_ids": [int(group["n_ids"].sum())], "ids_crc32": [crc], "round_trip": [bool(group["round_trip"].all())]})


def encoded(docs: DataFrame, path: str, kind: str = "bpe", giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip of every row."""
    own = narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")

    def whole(batches):
        model = pieces_of(path, kind)

        def rows():
            for doc_id, text in rows_of(batches):
                ids = model.encode(text)
                yield doc_id, len(ids), zlib.crc32(ids.tobytes()), model.decode(ids) == (text or "")

        return batches_of(rows(), RESULT_ARROW)

    usual = own.filter(F.coalesce(F.length("text"), F.lit(0)) < giant).mapInArrow(whole, RESULT)
    large = giant_ids(own.filter(F.length("text") >= giant), path, kind, chunk).drop("ids").groupBy("row").applyInPandas(_combined, RESULT)
    return usual.unionByName(large)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
