"""1. Token counts by a separator scan over flat, unindexed token files.

A flat token file is a run of little-endian unsigned ids of 2 or 4 bytes; every document ends with
one end-of-document id and nothing else tells where documents begin. Files are read in blocks.
Each block is searched with one vector comparison; the pieces at its edges are stitched to those of
its neighbours by the ordinal of their document, which an exclusive prefix sum of the blocks'
separator counts gives. The sum runs over two levels (blocks within spans, then spans), so one file
that holds most blocks isn't scanned by one task.

Defined results: an empty file has no document; two separators in a row make a document of 0 ids;
ids after the last separator make a document with closed = false; an id cut off at the end of a file
(length not a multiple of the width) is ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corvane.llm.common import batches_of, narrow, new_path, rows_of, written

DTYPES = {2: "<u2", 4: "<u4"}
#: Of the two-level sum: so many bytes (or other units of `block`) make a span.
SPAN = 1 << 30
BLOCK_SCHEMA = "file string, block long, content binary"
PIECE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_sep", pa.int64()), ("piece", pa.int64()), ("n_ids", pa.int64()), ("head", pa.binary())])


def record_bytes(length: int, most: int) -> int:
    """The largest divisor of a file's length that is at most `most`."""
    if length <= most:
        return length
    best, k = 1, 1
    while k * k <= length and k <= most:
        if length % k == 0:
            best = max(best, k, length // k if length // k <= most else 1)
        k += 1
    return best


def _joined(file: str, record: int, block_bytes: int):
    """Records (number, bytes) of one input split, in order, as blocks of block_bytes at whole ids."""

    def run(records: Iterable[tuple[int, bytearray]]) -> Iterator[tuple[str, int, bytearray]]:
        start, held = None, bytearray()
        for number, data in records:
            if start is None:
                start = number * record
            held += data
            while len(held) >= block_bytes:
                yield file, start, held[:block_bytes]
                start += block_bytes
                del held[:block_bytes]
        if held:
            yield file, start, held

    return run


def read_blocks(spark: SparkSession, path: str, width: int = 2, block_bytes: int = 1 << 20, whole_file_bytes: int = 256 << 20) -> DataFrame:
    """Blocks (file, block: the place of its first byte, content) of all files in a folder, read by Spark alone.

    Files up to whole_file_bytes are read by one task each. Longer ones are read in records, by as many
    tasks as they have input splits, and records are joined to blocks. Hadoop's record reader wants a
    length that divides the file's, so the largest divisor up to block_bytes is taken; splits are whole
    records and whole ids. A file without such a divisor (a prime number of bytes) is read in small
    records: slowly, but with the same blocks. Ids cut off at the end of a file are ignored either way.
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= whole_file_bytes).filter(F.col("length") >= width)
    at = F.explode(F.expr(f"sequence(0L, length - 1, {block_bytes}L)")).alias("block")
    out = small.select("path", "content", at).select(F.col("path").alias("file"), "block", F.expr(f"substring(content, int(block) + 1, {block_bytes})").alias("content"))
    for name, length in files.filter(F.col("length") > whole_file_bytes).select("path", "length").collect():  # names and lengths only
        record = record_bytes(length, block_bytes)
        unit = math.lcm(record, block_bytes)
        split = unit * max(1, (128 << 20) // unit) if unit <= 1 << 30 else record * width * max(1, (128 << 20) // (record * width))
        conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record), **{f"mapreduce.input.fileinputformat.split.{x}size": str(split) for x in ("min", "max")}}
        records = spark.sparkContext.newAPIHadoopFile(name, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        out = out.unionByName(spark.createDataFrame(records.mapPartitions(_joined(name, record, block_bytes)), BLOCK_SCHEMA))
    return out


def _pieces(eod: int, width: int, head: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for file, block, content in rows_of(batches):
                ids = np.frombuffer(content, DTYPES[width], count=len(content) // width)
                cuts = np.flatnonzero(ids == eod)
                starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(ids)]))
                raw, n = ids.tobytes(), len(cuts)
                for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    yield file, block, n, k, e - s, raw[s * width : min(e, s + head) * width]

        return batches_of(pieces(), PIECE)

    return scan


def token_counts(spark: SparkSession, blocks: DataFrame, eod: int, width: int = 2, head: int = 0, span: int = SPAN) -> DataFrame:
    """Documents of flat token files: file, ordinal (from 0), n_ids (without the separator), head
    (the first `head` ids, as bytes), closed (a separator ended it). Blocks of a file are ordered by `block`."""
    if width not in DTYPES:
        raise ValueError("width is 2 or 4")
    pieces = written(spark, blocks.mapInArrow(_pieces(eod, width, head), "file string, block long, n_sep long, piece long, n_ids long, head binary"), "token-pieces")
    sums = pieces.filter("piece = 0").select("file", "block", "n_sep", F.expr(f"block div {span}").alias("span"))
    in_span = sums.withColumn("within", F.sum("n_sep").over(W.partitionBy("file", "span").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    spans = sums.groupBy("file", "span").agg(F.sum("n_sep").alias("n")).select("file", "span", F.sum("n").over(W.partitionBy("file").orderBy("span").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    bases = in_span.join(spans, ["file", "span"]).select("file", "block", (F.coalesce("within", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("base"))
    placed = pieces.join(bases, ["file", "block"]).withColumn("ordinal", F.col("base") + F.col("piece"))
    edge = (F.col("piece") == 0) | (F.col("piece") == F.col("n_sep"))
    whole = placed.filter(~edge).select("file", "ordinal", "n_ids", "head", F.lit(True).alias("closed"))
    joined = F.expr("aggregate(sort_array(collect_list(if(length(head) > 0, struct(block, head), null))), cast('' as binary), (a, x) -> concat(a, x.head))")
    stitched = placed.filter(edge).groupBy("file", "ordinal").agg(F.sum("n_ids").alias("n_ids"), joined.alias("head"), F.max((F.col("piece") < F.col("n_sep"))).alias("closed"))
    stitched = stitched.select("file", "ordinal", "n_ids", F.expr(f"substring(head, 1, {head * width})").alias("head"), "closed")
    return whole.unionByName(stitched).filter("closed or n_ids > 0")


@cache
def byte_bpe(path: str):
    """A byte-level BPE of public ranks; ids below the number of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ID_DIGITS = 5


def id_head(doc_id: int | None, base: int) -> list[int]:
    """A document's id as ID_DIGITS token ids below base (0 stands for null)."""
    x, out = 0 if doc_id is None else doc_id + 2**63 + 1, []
    for _ in range(ID_DIGITS):
        x, d = divmod(x, base)
        out.append(d)
    return out


def head_id(head: bytes, base: int) -> int | None:
    x = sum(int(d) * base**k for k, d in enumerate(np.frombuffer(head, "<u2")))
    return x - 2**63 - 1 if x else None


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str, eod: int) -> None:
    """Tokenised texts as flat files of 2-byte ids: a head that spells doc_id, the text's ids, eod.

    Spark's text writer ends each row with the separator's two bytes, so the files hold nothing else.
    """

    def encoded(batches):
        def rows():
            encode = byte_bpe(vocabulary).encode_ordinary
            for doc_id, text in rows_of(batches):
                yield (np.array(id_head(doc_id, eod) + encode(text or ""), dtype="<u2").tobytes(),)

        return batches_of(rows(), pa.schema([("ids", pa.binary())]), 256)

    rows = narrow(docs, doc_id="doc_id:long", text="text:string").mapInArrow(encoded, "ids binary")
    rows.select(F.col("ids").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", eod.to_bytes(2, "little").decode("latin-1")).text(path)


def document_token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str, eod: int = 50256, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens of every document, read back from flat files: a null or empty text has 0.

    Repeated rows are counted each; a null doc_id stays null.
    """
    write_token_files(spark, docs, path := new_path(spark, "token-files"), vocabulary, eod)
    found = token_counts(spark, read_blocks(spark, f"{path}/part-*", 2, block_bytes), eod, 2, ID_DIGITS)

    def named(batches):
        return batches_of(((head_id(head, eod), n - ID_DIGITS) for head, n in rows_of(batches)), pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))

    return found.select("head", "n_ids").mapInArrow(named, T.StructType().add("doc_id", "long").add("n_tokens", "long"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
