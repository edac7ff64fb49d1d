"""The jobs as queries: each runs twice into one new folder, and gives the whole output as it then is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.plans.catalog import TOKENS, WINDOWS_SQL
from corpusframe.sources.session import new_folder
from jobs import chunk_index, term_index


def job1_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):
        chunk_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/chunks", f"{folder}/checkpoint")
    return chunk_index.current(spark, f"{folder}/chunks").drop("batch")


def job2_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        term_index.run(spark, f"{sf_dir}/documents.parquet", folder)
    postings, lengths, terms = term_index.tables(spark, folder)
    both = postings.withColumn("output", F.lit("postings")).unionByName(lengths.withColumn("output", F.lit("lengths")), allowMissingColumns=True)
    return both.unionByName(terms.withColumn("output", F.lit("terms")), allowMissingColumns=True)


QUERIES = {"job1_chunk_index": job1_chunk_index, "job2_term_index": job2_term_index}

ORACLE_SQL = {
    "job1_chunk_index": WINDOWS_SQL
    + """
SELECT w.doc_id, CAST(part AS INT) AS part, CAST(s + 1 AS INT) AS line_start, CAST(e AS INT) AS line_end, CAST(floor((p[e + 1] - p[s + 1] - 1) / 4) AS INT) AS token_count,
       array_to_string(l[s + 1:e], chr(10)) AS content, lang
FROM w JOIN d ON d.doc_id = w.doc_id JOIN documents ON documents.doc_id = w.doc_id
""",
    "job2_term_index": f"""
WITH d AS (SELECT doc_id, lang, {TOKENS.format("coalesce(text, '')")} AS t FROM documents),
     p AS (SELECT doc_id, lang, CAST(len(any_value(t)) AS INT) AS dl, term, CAST(count(*) AS INT) AS tf FROM (SELECT *, unnest(t) AS term FROM d) GROUP BY doc_id, lang, term)
SELECT 'postings' AS output, doc_id, dl, term, tf, NULL AS documents, NULL AS occurrences, lang FROM p
UNION ALL SELECT 'lengths', doc_id, CAST(len(t) AS INT), NULL, NULL, NULL, NULL, lang FROM d
UNION ALL SELECT 'terms', NULL, NULL, term, NULL, count(*), sum(tf), lang FROM p GROUP BY lang, term
""",
}
