"""Indexing as a stream: changes are applied in the order of their sequence numbers, in whatever order and however often they arrive.

The state of a stream has of each key its newest row, or what is needed to find it, deletions included, so a row that comes late changes nothing.  It is a
streaming aggregation: rows of one key are combined before they are shuffled, and what comes out of a batch is, for each key in it, the newest row of all
batches, which is applied as a whole.  Doing a batch again, or taking up a stream where it was left, gives the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusframe.operators import extract
from corpusframe.operators.collections import newest
from corpusframe.operators.lineage import held
from corpusframe.schemas import TABLES
from corpusframe.sources.catalog import Catalog
from corpusframe.sources.state import lock

SOURCE = "path string, content string, seq long, action string"
DELETE = "DELETE"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_stream(spark: SparkSession, folder: str, schema: str = SOURCE, max_files: int = 1000) -> DataFrame:
    """The files of a feed; `file` names the one that a row is in."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format("parquet").load(folder)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def newest_of(stream: DataFrame, key: str, order: str, carry: list[str]) -> DataFrame:
    """(key, order, carry...): of each key in a batch the newest row of all batches so far; of rows of one order the largest."""
    best = stream.groupBy(key).agg(F.max(F.struct(order, *carry)).alias("__newest"))
    return best.select(key, "__newest.*")


def upsert_batch(catalog: Catalog, name: str, key: str, action: str = "action", columns: list[str] | None = None):
    """A foreachBatch function over `newest_of`: the row takes the place of the key's old one, a deletion takes it away."""

    def run(batch: DataFrame, _: int) -> None:
        latest = held(batch)  # once out of the state store
        kept = latest.where(F.col(action) != DELETE)
        catalog.replace(name, kept.select(*(columns or [c for c in kept.columns if c != action])), latest.select(key), key)

    return run


def keep_current(stream: DataFrame, catalog: Catalog, name: str, key: str, order: str, checkpoint: str, action: str = "action", carry: list[str] | None = None) -> StreamingQuery:
    """Keeps a collection as the changes of a feed say; rows are small, so the state holds them."""
    more = carry if carry is not None else [c for c in stream.columns if c not in (key, order, action, "file")]
    return start(newest_of(stream, key, order, [action, *more]), upsert_batch(catalog, name, key, action), checkpoint, "update")


def index_batch(catalog: Catalog):
    """A foreachBatch function over `newest_of` source files: replaces all rows of the files that changed, in the buckets that hold them, in all three
    tables.  Texts are read from the feed's files, which must stay; the driver holds the names of those that have a newest row of the batch."""

    def run(batch: DataFrame, _: int) -> None:
        latest = held(batch)  # once out of the state store
        there = latest.where(F.col("action") != DELETE)
        names = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.file) for r in there.select("file").distinct().collect()]
        fed = batch.sparkSession.read.schema(SOURCE).parquet(*names) if names else batch.sparkSession.createDataFrame([], SOURCE)
        sources = newest(fed.join(there.select("path", "seq"), ["path", "seq"], "left_semi").where(F.col("action") != DELETE), "path", "seq")
        got = extract.parsed(sources).persist()
        for name, column, rows in (("symbols", "file_path", extract.symbols_of(got)), ("chunks", "file_path", extract.chunks_of(got)), ("files", "path", extract.files_of(got))):
            catalog.replace(name, rows.select(*TABLES[name].names), latest.select(F.col("path").alias(column)), column)
        got.unpersist()

    return run


def keep_indexed(spark: SparkSession, feed: str, catalog: Catalog, checkpoint: str, max_files: int = 1000, lock_path: str | None = None) -> StreamingQuery:
    """Keeps the index of the source files that a folder of changes (SOURCE) tells of; the state has the number and place of each path's newest row."""
    function = index_batch(catalog)
    stream = newest_of(change_stream(spark, feed, max_files=max_files), "path", "seq", ["action", "file"])
    return start(stream, unless_locked(function, lock_path) if lock_path else function, checkpoint, "update")


def unless_locked(function, lock_path: str):
    """A foreachBatch function that waits for nobody: a batch that comes while another run holds the lock fails at once, and is done again later."""

    def run(batch: DataFrame, number: int) -> None:
        with lock(lock_path):
            function(batch, number)

    return run


def start(stream: DataFrame, function, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, then stop; started again it goes on where it was.  State is kept on the executors' disks and in the checkpoint."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ON_DISK)  # a query takes the settings of the moment it starts
    try:
        return stream.writeStream.foreachBatch(function).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(STATE_STORE)
        else:
            conf.set(STATE_STORE, before)


def windowed_counts(events: DataFrame, moment: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by kind and window, with a watermark, for streams and tables alike."""
    return events.withWatermark(moment, late).groupBy(F.window(moment, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
