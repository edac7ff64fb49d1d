"""Builds the term index of a table of documents anew: postings, lengths and a vocabulary, a partition for each language.

    python -m jobs.term_index --documents hdfs:///docs --output hdfs:///index/terms

Three tables, each overwritten as a whole: `postings` (which documents have a term, and how often), `lengths` (words of each document) and `terms` (how many
documents have a term, and how often it comes).  Postings are dealt out by ranges of language, term and document, so a very common term fills
several files and no task, and are sorted by term within a file: a search reads the pages of its terms in the partition of its language.  The vocabulary
and its counts are read from the postings as they were written.

Defined results: a null or empty text has no word and a length of 0.  Rows without a document's key are kept as they are.  Repeated rows are
repeated in postings and lengths, and count as often in the vocabulary.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.operators import postings
from jobs.common import command, config, counting, opened, total

LOG = logging.getLogger("term_index")
POSTINGS = "doc_id long, dl int, term string, tf int, lang string"
LENGTHS = "doc_id long, dl int, lang string"
TERMS = "term string, documents long, occurrences long, lang string"


def written(df: DataFrame, path: str, order: list[str], **counts) -> dict:
    """Writes a table by language, in ranges and sorted by `order`; what was counted on the way.  Ranges take two passes over the rows, so these are
    written as they come first, beside the table, and texts are taken apart once."""
    rows, seen = counting(df, **counts)
    found = postings.unsorted(rows, f"{path}-unsorted")
    found.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order).write.mode("overwrite").partitionBy("lang").parquet(path)
    return seen.get


def run(spark: SparkSession, documents: str, output: str, settings: dict | None = None) -> dict:
    """Builds the three tables; counts of documents, words, postings and terms."""
    settings, output = config("term_index") | (settings or {}), output.rstrip("/")
    docs = spark.read.parquet(documents).select(F.col(settings["key"]).cast("long").alias("doc_id"), "lang", F.col(settings["text"]).alias("text"))
    sizes = postings.lengths(docs, "doc_id", ["text"], ["lang"]).drop("field")
    done = written(sizes, f"{output}/lengths", ["doc_id"], documents=F.count("*"), words=total("dl"))
    LOG.info("read %s: %s documents, %s words", documents, done["documents"], done["words"])
    found = postings.postings(docs, "doc_id", ["text"], ["lang"]).drop("field")
    done |= written(found, f"{output}/postings", ["term", "doc_id"], postings=F.count("*"))
    there = opened(spark, f"{output}/postings", POSTINGS)
    terms = there.groupBy("lang", "term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))
    done |= written(terms, f"{output}/terms", ["term"], terms=F.count("*"))
    LOG.info("wrote %s: %s postings, %s terms", output, done["postings"], done["terms"])
    return done


def tables(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, lengths and terms as they are on disk."""
    return tuple(opened(spark, f"{output.rstrip('/')}/{name}", schema) for name, schema in (("postings", POSTINGS), ("lengths", LENGTHS), ("terms", TERMS)))


if __name__ == "__main__":
    command("term_index", __doc__.splitlines()[0], ["documents", "output"], run)
