"""The document store on plain Parquet: appends, tombstones, latest-wins status, existence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corvane.sources.shared import written

DOCUMENTS = T.StructType().add("doc_id", "string").add("filename", "string").add("total_pages", "integer").add("status", "string").add("doc_metadata", "string").add("created_at", "timestamp")
SENTENCES = (
    T.StructType()
    .add("id", "string")
    .add("doc_id", "string")
    .add("page_num", "integer")
    .add("paragraph_id", "string")
    .add("sentence_id", "string")
    .add("text", "string")
    .add("char_offset_start", "integer")
    .add("char_offset_end", "integer")
    .add("item_type", "string")
)


def document_id(filename, created_at):
    """A deterministic id, so that a retried insert is the same row."""
    return F.md5(F.concat_ws(":", filename, created_at.cast("string")))


def defaults(documents: DataFrame) -> DataFrame:
    return documents.withColumn("status", F.coalesce("status", F.lit("processing"))).withColumn("doc_metadata", F.coalesce("doc_metadata", F.lit("{}")))


def lookup(documents: DataFrame, doc_id) -> DataFrame:
    return defaults(documents).filter(F.col("doc_id") == doc_id)


def listed(documents: DataFrame) -> DataFrame:
    """Newest first; a total order."""
    return documents.orderBy(F.desc("created_at"), "doc_id")


def numbered(spark: SparkSession, ordered: DataFrame, name: str) -> DataFrame:
    """A sorted frame with the place of each row, from 1, under `name`.

    The rows are written once with the partition that each lies in, so that the sizes of partitions and
    the rows are read from the same deal; only one row a partition is summed up in one task.
    """
    own = written(spark, ordered.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    sizes = own.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).select(*ordered.columns, name)


def with_status(documents: DataFrame, log: DataFrame) -> DataFrame:
    """documents under the last status that the append-only log (doc_id, status, ts) has of each;
    of two at one time the larger name."""
    last = log.groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "status")).alias("__status"))
    return documents.join(last, "doc_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def without(rows: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows of no deleted key; the same tombstones go to sentences, vectors and postings (the cascade)."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def insertable(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """new rows whose key isn't stored, with item_type's default. A key twice in `new` is an error."""
    twice = new.groupBy(key).count().filter("count > 1").limit(1)
    if twice.count():
        raise ValueError(f"{key} occurs twice")
    own = new.withColumn("item_type", F.coalesce("item_type", F.lit("paragraph"))) if "item_type" in new.columns else new
    return own.join(stored.select(key), key, "left_anti")


def latest_by_id(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """An index upsert: the last version of each id."""
    from corvane.operators.cache import latest

    return latest(rows, key, (order,))


def pages_to_ingest(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, page_num) not stored yet."""
    return wanted.join(stored.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_anti")


def pages_present(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")


def append(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def compact(spark: SparkSession, path: str, to: str, bytes_per_file: int = 256 << 20) -> None:
    """Small files rewritten into few, without a shuffle of rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    total = files.agg(F.sum("length")).first()[0] or 0
    spark.read.parquet(path).coalesce(max(1, -(-total // bytes_per_file))).write.parquet(to)
