"""Lines that many documents share, dropped but in one document, in DataFrame functions alone.

Lines are exploded and named by 128 bits of their key (blanks stripped at both ends, A-Z lower-cased).  The documents that hold a key are counted in two
steps: distinct pairs of key and document first, which no key makes a hot one, then keys, of which a task hands on one row each.  The lines of the keys
found often enough are then sought again and their positions put together for each document; keys in a great many lines are dealt over several tasks.
Documents that lose a line are put together again by position.

Defined results: a null or empty text is one empty line.  A text may be a key's document once only, however often it has it.  Rows of one doc_id are one
document, each with its own lines; rows without a doc_id count as no document, and lose the lines that others lose.  Ties can't be: the largest doc_id
is one document.  Repeated rows give repeated rows, an empty table an empty one.  Columns with any names are handed on, but for n_lines and n_dropped,
which are replaced.  A text is one value of the JVM, lines and all, so a very long one (some hundred MB) needs an executor's heap to match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import dropped, salted, shielded, stored, table, text_of

BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENTS = 3  # that hold a key, at least, for its lines to go
CHARS = 20  # of a key, at least
NAME = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def key_of(line: Column) -> Column:
    """The line stripped and with A-Z in lower case; `lower` says the same of ASCII, and says it faster."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def named(lines: DataFrame, line: str, chars: int = CHARS) -> DataFrame:
    """The lines whose key is long enough, with its name in place of the line."""
    keep = [c for c in lines.columns if c != line]
    keys = lines.select(*keep, key_of(F.col(line)).alias("__key")).where(F.char_length("__key") >= chars)
    return keys.select(*keep, F.xxhash64("__key").alias("h1"), F.xxhash64(F.lit("second"), "__key").alias("h2"))


def common_keys(docs: DataFrame, least: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """(h1, h2, times, last) of the keys that enough documents hold: how many lines have them, and the largest document, of (doc, text) rows."""
    lines = named(docs.select("doc", F.explode(lines_of(F.col("text"))).alias("line")), "line", chars)
    pairs = lines.groupBy(*NAME, "doc").agg(F.count("*").alias("times"))
    keys = pairs.groupBy(*NAME).agg(F.count("doc").alias("documents"), F.sum("times").alias("times"), F.max("doc").alias("last"))
    return keys.where(F.col("documents") >= least).drop("documents")


def dropped_positions(docs: DataFrame, keys: DataFrame, chars: int = CHARS) -> DataFrame:
    """(doc, row, gone): the positions of the lines that a row's text loses; a row is named by its document and a hash of its text."""
    total = keys.agg(F.sum("times")).first()[0] or 0
    lines = named(docs.select("doc", "row", F.posexplode(lines_of(F.col("text"))).alias("at", "line")), "line", chars)
    found = salted(lines, keys, NAME, "times", ["doc", "row", "at"], total)
    return found.where(~F.col("doc").eqNullSafe(F.col("last"))).groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))


@shielded("text", "key")
def drop_common_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = DOCUMENTS, chars: int = CHARS) -> DataFrame:
    """All columns, the text without the lines that are dropped, and n_lines (before), n_dropped."""
    whole = text_of(docs, text)
    rows = docs.select(F.col(key).alias("doc"), whole.alias("text"))
    keys = stored(common_keys(rows, least, chars), "line-keys")
    gone = stored(dropped_positions(rows.withColumn("row", F.xxhash64("text")), keys, chars), "line-places")
    dropped(keys)
    places = gone.toDF("__doc", "__of", "__gone")
    both = docs.withColumn("__row", F.xxhash64(whole)).join(places, F.col(key).eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__of")), "left")
    lines, at = F.col("__lines"), F.col("__gone")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: F.get(lines, i))
    kept = F.when(at.isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return both.withColumn("__lines", lines_of(F.coalesce(F.col(text).cast("string"), F.lit("")))).select(
        *[kept.alias(text) if c == text else c for c in docs.columns], F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped")
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
     x AS (SELECT r, doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS p FROM d),
     k AS (SELECT *, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
     f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     g AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY r
"""
