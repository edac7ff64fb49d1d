"""Keeps the chunks of a growing folder of documents, for search by text: takes the files that are new since the last run, and no others.

    python -m jobs.chunk_index --documents hdfs:///docs --output hdfs:///index/chunks --checkpoint hdfs:///index/chunks-checkpoint

The folder is a file stream, read up to what is there now; its checkpoint knows which files are done.  Each micro-batch of at most `max_files` files cuts
its documents into overlapping windows of whole lines and writes them as `output/batch=<number>/lang=<language>`.  A batch that is done again, after a
run that failed, overwrites its own folder and nothing else, so a rerun gives the same rows.  A document that comes again replaces what it was:
`current` gives each document's chunks of the last batch that has it.

Defined results: of rows of one doc_id within a batch the one of the newest file counts, among equals the largest text.  A null or empty text is one
empty chunk.  Rows without a doc_id can't be replaced later; they are counted in the log and not indexed.  A null language is a partition of its own.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.operators import collections, windows
from jobs.common import command, config, counting, opened, total

LOG = logging.getLogger("chunk_index")
CHUNKS = "doc_id long, part int, line_start int, line_end int, token_count int, content string, batch int, lang string"


def watched(spark: SparkSession, documents: str, settings: dict) -> DataFrame:
    """The documents as a stream, with the moment their file was written.

    A stream reads a folder or a glob, but no path of a single file; so the path's last letter becomes a class of one letter."""
    path = documents.rstrip("/")
    glob = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(settings["schema"]).option("maxFilesPerTrigger", settings["max_files"]).parquet(glob)
    return stream.select("doc_id", "text", "lang", F.col("_metadata.file_modification_time").alias("arrived"))


def index_batch(output: str, done: dict):
    """A foreachBatch function that writes a batch's chunks and adds to the counts of what was done."""

    def run(batch: DataFrame, number: int) -> None:
        rows, read = counting(batch, rows=F.count("*"), without_key=F.count_if(F.col("doc_id").isNull()))
        latest = collections.newest(rows.where("doc_id IS NOT NULL"), "doc_id", "arrived").drop("arrived")
        chunks, wrote = counting(windows.chunks(latest, "text"), chunks=F.count("*"), documents=F.count_if(F.col("part") == 0), tokens=total("token_count"))
        chunks.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/batch={number}")
        told = {**read.get, **wrote.get}
        for k, v in told.items():
            done[k] = done.get(k, 0) + v
        done["batches"] = done.get("batches", 0) + 1
        LOG.info("batch %d: read %s rows (%s without doc_id), wrote %s chunks of %s documents, %s tokens", number, *[told[k] for k in ("rows", "without_key", "chunks", "documents", "tokens")])

    return run


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None) -> dict:
    """Indexes what is new; counts of batches, rows read, documents, chunks and tokens written (none of which is there if nothing is new)."""
    settings, done = config("chunk_index") | (settings or {}), {}
    output = output.rstrip("/")
    stream = watched(spark, documents, settings).writeStream.foreachBatch(index_batch(output, done))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    LOG.info("%s: %s", output, done or "nothing new")
    return done


def current(spark: SparkSession, output: str) -> DataFrame:
    """Each document's chunks of the last batch that has it.  What is left out is found from keys alone; only documents that came again are in that set."""
    rows = opened(spark, output, CHUNKS)
    last = rows.where("part = 0").groupBy("doc_id").agg(F.max("batch").alias("last"), F.count("*").alias("times"))
    again = last.where("times > 1").select("doc_id", "last")
    stale = again.select(F.col("doc_id").alias("again"), "last")
    return rows.join(stale, (F.col("doc_id") == F.col("again")) & (F.col("batch") < F.col("last")), "left_anti")


if __name__ == "__main__":
    command("chunk_index", __doc__.splitlines()[0], ["documents", "output", "checkpoint"], run)
