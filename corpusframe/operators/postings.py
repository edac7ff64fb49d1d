"""An inverted index as tables: which rows have a term, and how often; built when rows are indexed, read by term when they are searched.

`postings` has one row for each (field, term, row).  A collection of them is written in segments that are sorted by term, so that a search, whose
terms are pushed down to the scan, reads those pages only that hold them.  `lengths` has one row for each row and field.  Scores and statistics are
those of `scoring.bm25` over the texts themselves.

With `places` a row has the term's positions too, and phrases are found from the index.  `neighbourhood` is a dictionary for fuzzy terms: a term stands in
it under each way to leave out some letters of its first `HEAD`, so terms within as many edits of a word share such a rest with it, and a lookup by the
word's own rests gives a few candidates to compare.  No text is read when an index is searched.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions.text import terms_of, tokens
from corpusframe.operators.scoring import K1, B, let, weighted

#: Letters of a term whose deletions are looked up; more than the edits.
HEAD = 7
EDITS = 2
#: So many terms at most are named in a filter that the scan gets; beyond that they are joined.
PUSHED = 1000
#: So many rows a range of a sorted table has, about: what a task sorts at once.
RANGE = 1_000_000


def counted(words: Column) -> Column:
    """array<struct<term, tf>>: the distinct words and how often each comes, from runs of the sorted words."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(heads, lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s))), lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(words) > 0, let(F.sort_array(words), runs)).otherwise(none)


def placed(words: Column) -> Column:
    """array<struct<term, tf, at>>: as `counted`, with the positions of each word in order."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))

        def each(a: Column, b: Column) -> Column:
            return F.struct(F.get(s, a)["w"].alias("term"), (b - a).alias("tf"), F.transform(F.slice(s, a + 1, b - a), lambda x: x["i"]).alias("at"))

        return let(heads, lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s))), each))

    none = F.array().cast("array<struct<term:string,tf:int,at:array<int>>>")
    ordered = F.sort_array(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    return F.when(F.size(words) > 0, let(ordered, runs)).otherwise(none)


def _fields(df: DataFrame, key: str, fields: list[str], keep: list[str], of_words) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("w")) for f in fields])
    return df.select(*dict.fromkeys([key, *keep]), F.inline(F.transform(each, lambda x: F.struct(x["field"].alias("field"), F.size(x["w"]).alias("dl"), *of_words(x["w"])))))


def postings(df: DataFrame, key: str, fields: list[str], keep: list[str] = (), places: bool = False) -> DataFrame:
    """(key, `keep` columns, field, dl, term, tf[, at]); nothing is shuffled."""
    rows = _fields(df, key, fields, list(keep), lambda w: [(placed if places else counted)(w).alias("terms")])
    return rows.select(*[c for c in rows.columns if c != "terms"], F.inline("terms"))


def lengths(df: DataFrame, key: str, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """(key, `keep` columns, field, dl), also of rows without a word."""
    return _fields(df, key, fields, list(keep), lambda w: [])


def unsorted(df: DataFrame, path: str) -> DataFrame:
    """The rows on disk in the order in which they come."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, *order: str) -> DataFrame:
    """The table on disk, in ranges of `order` and sorted by it within files, so that a filter on its first column reads the pages that hold its values.
    A value that many rows have is dealt over several tasks by the columns after it.

    Ranges are found by a pass over the rows before the one that moves them, so the rows are written as they come first (`path`-unsorted): they are
    worked out once, and both passes read what is there.  A large table has as many ranges as its rows ask for, so what a task
    sorts does not grow with it; the number is given, so adaptive execution, which goes by compressed bytes, puts none together."""
    spark, found = df.sparkSession, unsorted(df, f"{path.rstrip('/')}-unsorted")
    ranges = -(-found.count() // RANGE)  # from the files' footers
    given = [ranges] if ranges > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else []
    found.repartitionByRange(*given, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def phrase(index: DataFrame, words: str, key: str, field: str, slop: int = 0) -> DataFrame:
    """(key) of the rows that have the words in order, each at most slop + 1 after the one before; from an index with places."""
    terms = re.findall(r"\w+", words.lower())
    distinct = list(dict.fromkeys(terms))
    if not terms:
        return index.select(key).limit(0)
    found = index.where(F.col("term").isin(*distinct) & (F.col("field") == field)).select(key, "term", "at")
    rows = found.groupBy(key).agg(*[F.first(F.when(F.col("term") == t, F.col("at")), ignorenulls=True).alias(f"__at{i}") for i, t in enumerate(distinct)])
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(f"__at{i}").isNotNull() for i in range(len(distinct))]))

    def follow(reached: Column, term: str) -> Column:
        ahead = F.flatten(F.transform(reached, lambda x: F.sequence(x + 1, x + slop + 1)))
        return F.array_intersect(F.col(f"__at{distinct.index(term)}"), ahead)

    return rows.where(F.size(reduce(follow, terms[1:], F.col("__at0"))) > 0).select(key)


def vocabulary(index: DataFrame) -> DataFrame:
    """(field, term, df): how many rows have a term."""
    return index.groupBy("field", "term").agg(F.count("*").alias("df"))


def rests(text: Column, edits: int = EDITS) -> Column:
    """The text and what is left of it without one letter, or up to `edits` letters."""

    def without_one(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    levels = [F.array(text)]
    for _ in range(edits):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], without_one))))
    return F.array_distinct(F.concat(*levels))


def rests_of(text: str, edits: int = EDITS) -> set[str]:
    """The same of a word of a query."""
    out, last = {text}, {text}
    for _ in range(edits):
        last = {s[:i] + s[i + 1 :] for s in last for i in range(len(s))}
        out |= last
    return out


def neighbourhood(vocabulary: DataFrame, edits: int = EDITS, head: int = HEAD) -> DataFrame:
    """(rest, field, term, df): the dictionary for up to `edits` edits, some 30 rows a term, however long it is."""
    return vocabulary.select(F.explode(rests(F.substring("term", 1, head), edits)).alias("rest"), "field", "term", "df")


def near(dictionary: DataFrame, field: str, word: str, max_edits: int = EDITS, prefix_length: int = 0, head: int = HEAD) -> DataFrame:
    """(term, df) of the terms within some edits of a word, of a dictionary for as many at least."""
    word = word.lower()
    found = dictionary.where(F.col("rest").isin(*sorted(rests_of(word[:head], max_edits))) & (F.col("field") == field))
    same = F.col("term").startswith(word[:prefix_length]) & (F.levenshtein("term", F.lit(word), max_edits) >= 0)
    return found.where(same).select("term", "df").distinct()


def expanded(index: DataFrame, sizes: DataFrame, terms: DataFrame, key: str, field: str, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score): BM25 over all of the terms (term, df)."""
    few = [r.term for r in terms.select("term").limit(PUSHED + 1).collect()]
    rows = index.where(F.col("field") == field).select(key, "term", "dl", "tf")
    rows = rows.where(F.col("term").isin(*few)) if len(few) <= PUSHED else rows
    stats = sizes.where(F.col("field") == field).agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("dl").alias("average")).alias("s")).select("s").scalar()
    joined = rows.join(terms, "term").withColumn("s", stats)
    score = weighted(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("dl").cast("double"), F.col("s.n"), F.col("s.average"), k1, b)
    return joined.groupBy(key).agg(F.sum(score).alias("score"))


def prefix(index: DataFrame, sizes: DataFrame, key: str, field: str, start: str) -> DataFrame:
    """(key, score) over all terms that begin so, a range of the index."""
    return expanded(index, sizes, vocabulary(index.where(F.col("term").startswith(start.lower()) & (F.col("field") == field))).select("term", "df"), key, field)


def fuzzy(index: DataFrame, sizes: DataFrame, dictionary: DataFrame, key: str, field: str, word: str, max_edits: int = EDITS, prefix_length: int = 0) -> DataFrame:
    """(key, score) over all terms near a word."""
    return expanded(index, sizes, near(dictionary, field, word, max_edits, prefix_length), key, field)


def bm25(index: DataFrame, sizes: DataFrame, query: str | list[str], key: str, fields: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of all rows that have a term of the query in one of the fields."""
    terms = terms_of(query) if isinstance(query, str) else list(dict.fromkeys(query))
    found = index.where(F.col("term").isin(*terms) & F.col("field").isin(*fields)).select(key, "field", "term", "dl", "tf")
    often = found.groupBy("field", "term").agg(F.count("*").cast("double").alias("df"))  # one row for each field and term of the query
    stats = sizes.groupBy("field").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("average"))  # and for each field
    rows = found.join(F.broadcast(often), ["field", "term"]).join(F.broadcast(stats), "field")
    score = weighted(F.col("tf").cast("double"), F.col("df"), F.col("dl").cast("double"), F.col("n"), F.col("average"), k1, b)
    return rows.groupBy(key).agg(F.sum(score).alias("score"))
