"""Source files as rows.  The folder is listed first, without contents; only the files that are wanted by path are then read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.functions import paths

SNIFFED_BYTES = 8192


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192, or nothing to read."""
    return content.isNull() | (F.position(F.lit(b"\x00"), F.substring(content, 1, SNIFFED_BYTES)) > 0)


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that aren't become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def _relative(root: str) -> Column:
    base = root.rstrip("/") + "/"
    at = F.instr(F.col("path"), F.lit(base.split("://")[-1]))
    return F.substring(F.col("path"), at + len(base.split("://")[-1]), F.length("path"))


def _binary(spark: SparkSession, paths_: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths_)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to the root, whole path, mtime, size) of all files below a folder; nothing is read but the folder's lists."""
    return _binary(spark, root).select(_relative(root).alias("path"), F.col("path").alias("whole"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def scan(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path relative to the root, mtime, size, content binary); `wanted` is a part of the listing.

    The driver holds the wanted names, as it does for any scan of files."""
    names = root if wanted is None else [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.whole) for r in wanted.select("whole").collect()]
    columns = [_relative(root).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content")]
    return _binary(spark, names).select(*columns) if names else spark.createDataFrame([], "path string, mtime timestamp, size long, content binary")


def listed(spark: SparkSession, root: str, tracked: DataFrame | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """The listing of the files to index; `tracked` (path) restricts them to those under version control."""
    wanted = listing(spark, root).where(paths.indexable(F.col("path"), suffixes) & ~paths.skipped(F.col("path")))
    return wanted if tracked is None else wanted.join(tracked.select("path"), "path", "left_semi")


def texts(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, mtime, size, content, content_hash) of a part of the listing; content and hash are null of files that are no text."""
    rows = scan(spark, root, wanted)
    text = F.when(~is_binary(F.col("content")), decoded(F.col("content")))
    return rows.withColumn("content", text).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def sources(spark: SparkSession, root: str, tracked: DataFrame | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """(path, mtime, size, content string) of the files to index."""
    rows = scan(spark, root, listed(spark, root, tracked, suffixes))
    return rows.where(~is_binary(F.col("content"))).withColumn("content", decoded(F.col("content")))


def snapshot(files: DataFrame) -> DataFrame:
    """(path, mtime, size, content_hash) for the next run's difference."""
    return files.select("path", "mtime", "size", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
