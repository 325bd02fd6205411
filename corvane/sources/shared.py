"""Tables in the folder that driver and executors share (spark.checkpoint.dir).

They last as long as the application: the driver's JVM removes them when it ends. A table that is no
longer read can go earlier, by released().
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only in local mode, where it names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path, on the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    return path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the table holds the rows, so the shuffle files can go as soon as it stands
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that written() returned and that no frame reads any more."""
    for x in tables:
        if path := getattr(x, "_written_at", None):
            files, at = file_system(spark, path)
            files.delete(at, True)
