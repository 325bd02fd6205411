"""Sources: Parquet tables, workspace texts, PDF files through an injected extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import truncated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under a path whose name ends with .pdf (case-sensitive)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").endswith(".pdf")).select("path", "content")


def pdf_pages(files: DataFrame, page_count: Callable[[bytes], int]) -> DataFrame:
    """(path, content, page_num), one row a page, from 1; the page counter is a plug-in."""

    @F.pandas_udf("int")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda x: page_count(bytes(x)))

    return files.withColumn("n", pages("content")).filter("n > 0").select("path", "content", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_num"))


def extracted_pages(pages: DataFrame, extract: Callable[[bytes, int], str]) -> DataFrame:
    """(path, page_num, markup, error): the extractor turns a page into canonical markup. A page on which
    it fails keeps its row, with a null markup and the error, and stops no other."""

    def one(content: bytes, page: int) -> tuple[str | None, str | None]:
        try:
            return extract(content, page), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [one(bytes(c), int(p)) for c, p in zip(x["content"], x["page_num"], strict=True)]
            yield pd.DataFrame({"path": x["path"], "page_num": x["page_num"], "markup": [m for m, _ in found], "error": [e for _, e in found]})

    return pages.mapInPandas(run, "path string, page_num int, markup string, error string")


def failed_pages(extracted: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages to try again: a dead-letter table joined back to its input."""
    return pages.join(extracted.filter("error is not null").select("path", "page_num"), ["path", "page_num"], "left_semi")


def workspace_files(spark: SparkSession, paths: list[str], most: int = 20_000) -> DataFrame:
    """(path, content) of whole text files, each cut at `most` characters with a mark."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), truncated(F.col("value"), most).alias("content"))
