"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.shared import new_path, released, written

__all__ = ["A_TO_Z", "SPACES", "batches_of", "bucketed", "dropped", "joined_by_group", "lower_words_of", "narrow", "new_path", "released", "rows_of", "words_of", "written"]

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() cuts at just these bytes.
SPACES = " \t\n\x0b\x0c\r"
A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8; a null text has none."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As words_of(), with only A-Z lower-cased."""
    return text.encode().translate(A_TO_Z).split() if text else []


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; extra columns can't clash.

    columns: own name -> "column:type".
    """
    return docs.select(*(F.col(f"`{spec.split(':')[0]}`").cast(spec.split(":")[1]).alias(own) for own, spec in columns.items()))


def bucketed(spark: SparkSession, df: DataFrame, parts: int, column: str, name: str) -> DataFrame:
    """df, dealt by a column to as many partitions, as a table of so many buckets in the shared folder: what groups
    it by that column later moves none of its rows."""
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(parts, column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._written_at, out._table = path, table
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that bucketed() returned and that no frame reads any more."""
    for x in tables:
        spark.sql(f"DROP TABLE IF EXISTS {x._table}")
        released(spark, x)


#: Groups up to so many rows are left to one task; of larger ones, of over one row in a thousand, there are at most a thousand.
GROUP_ROWS, HOT_GROUPS = 1000, 1000


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, total: int, shuffled: bool = False) -> DataFrame:
    """rows joined on a key to groups (one row a key, with n, its number of rows) where there are `total`
    rows. The large groups' side is broadcast, so their rows stay where they are. shuffled: the others are
    shuffled at any size, not broadcast while they are few, so that the plan is that of a large input."""
    if total <= 10 * GROUP_ROWS:
        return rows.join(groups.drop("n"), key)
    large = F.col("n") > max(GROUP_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(groups.filter(large).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.filter(~large).drop("n").hint("merge") if shuffled else groups.filter(~large).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time, so a batch of long texts isn't held twice."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most size rows."""
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held.clear()
    if held:
        yield made()
