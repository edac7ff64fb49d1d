"""Ranked retrieval as Column expressions: BM25, phrases, prefixes, fuzzy terms, vectors, hybrids, decay, query strings.

Scores come from one pass for the collection's statistics, a single row that the scoring pass gets as a scalar subquery, and one pass that
scores; each finds a row's words once (the counts come out of a generator, through which the optimizer pushes no copy of them); no row is
shuffled but for the final top k.  Filters do not change the statistics.  `operators.postings` answers the same queries from a stored term table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions.text import terms_of, tokens

K1, B = 1.2, 0.75
TEXT_WEIGHT = 0.4


def _times(words: Column, term: str) -> Column:
    return (F.size(words) - F.size(F.array_remove(words, term))).cast("double")


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def weighted(tf: Column, df: Column, dl: Column, n: Column, average: Column, k1: float, b: float) -> Column:
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return F.when(tf > 0, idf * tf / (tf + k1 * (1 - b + b * dl / average))).otherwise(0.0)


def bm25(df: DataFrame, query: str | list[str], fields: list[str], predicate: Column | None = None, min_score: float = 0.0, k1: float = K1, b: float = B) -> DataFrame:
    """Rows that match one of the terms, with `score`: the sum over fields and terms.  An empty query matches all with score 1."""
    terms = terms_of(query) if isinstance(query, str) else list(dict.fromkeys(query))
    if not terms:
        out = df if predicate is None else df.where(predicate)
        return out.withColumn("score", F.lit(1.0))

    def counted(rows: DataFrame, wanted=None) -> DataFrame:
        """The rows, or those that pass a test of their counts, with lengths and term counts."""

        def counts(s: Column) -> Column:
            words = [s[f"w{i}"] for i in range(len(fields))]
            sizes = [F.size(w).cast("double").alias(f"__dl{i}") for i, w in enumerate(words)]
            return F.struct(*sizes, *[_times(w, t).alias(f"__tf{i}_{j}") for i, w in enumerate(words) for j, t in enumerate(terms)])

        found = F.transform(F.array(F.struct(*[tokens(F.col(f)).alias(f"w{i}") for i, f in enumerate(fields)])), counts)
        return rows.select("*", F.inline(found if wanted is None else F.filter(found, wanted)))

    statistics = [F.count("*").cast("double").alias("n")]
    for i in range(len(fields)):
        statistics.append(F.avg(f"__dl{i}").alias(f"avg{i}"))
        statistics += [F.sum((F.col(f"__tf{i}_{j}") > 0).cast("double")).alias(f"df{i}_{j}") for j in range(len(terms))]
    stats = counted(df.select(*fields)).agg(F.struct(*statistics).alias("s")).select("s").scalar()
    def matched(s: Column) -> Column:
        return reduce(lambda a, c: a | c, [s[f"__tf{i}_{j}"] > 0 for i in range(len(fields)) for j in range(len(terms))])

    rows = counted(df if predicate is None else df.where(predicate), matched).withColumn("__s", stats)
    parts = [
        weighted(F.col(f"__tf{i}_{j}"), F.col(f"__s.df{i}_{j}"), F.col(f"__dl{i}"), F.col("__s.n"), F.col(f"__s.avg{i}"), k1, b) for i in range(len(fields)) for j in range(len(terms))
    ]
    out = rows.withColumn("score", reduce(lambda a, c: a + c, parts)).select(*df.columns, "score")
    return out.where(F.col("score") >= min_score) if min_score > 0 else out


def phrase_slop(words: list[str], text: Column, slop: int = 0) -> Column:
    """Whether the words come in order, each at most slop + 1 after the one before."""

    def there(w: Column) -> Column:
        def follow(reached: Column, rest: list[str]) -> Column:
            if not rest:
                return F.size(reached) > 0
            after = F.filter(_positions(w, rest[0]), lambda j: F.exists(reached, lambda i: (j - i >= 1) & (j - i <= slop + 1)))
            return let(after, lambda found: follow(found, rest[1:]))

        return let(_positions(w, words[0]), lambda found: follow(found, words[1:]))

    return let(tokens(text), there) if words else F.lit(False)


def _positions(words: Column, term: str) -> Column:
    return F.filter(F.transform(words, lambda x, i: F.when(x == term, i)), lambda p: p.isNotNull())


def phrase(df: DataFrame, words: str, field: str, slop: int = 0) -> DataFrame:
    """Rows that hold the phrase; a cheap test for all of its words comes first."""
    terms = re.findall(r"\w+", words.lower())
    text = F.lower(F.col(field))
    there = reduce(lambda a, b: a & b, [text.contains(t) for t in dict.fromkeys(terms)], F.lit(True))
    return df.where(there).where(phrase_slop(terms, F.col(field), slop))


def vocabulary(df: DataFrame, field: str, test) -> DataFrame:
    """The distinct tokens of a field that pass a test, with the number of rows that have them."""
    return df.select(F.explode(F.array_distinct(F.filter(tokens(F.col(field)), test))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def expanded(df: DataFrame, key: str, field: str, test, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 over all tokens of a field that pass a test: (key, score).  The tokens' document counts are joined, not collected."""
    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("double").alias("dl"), F.filter(w, test).alias("found"))

    rows = df.select(key, F.inline(F.transform(F.array(tokens(F.col(field))), counts)))
    stats = rows.agg(F.struct(F.count("*").cast("double").alias("n"), F.avg("dl").alias("average")).alias("s")).select("s").scalar()
    tf = rows.select(key, "dl", F.explode("found").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").cast("double").alias("tf"))
    terms = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    joined = tf.join(terms, "term").withColumn("s", stats)
    return joined.groupBy(key).agg(F.sum(weighted(F.col("tf"), F.col("df"), F.col("dl"), F.col("s.n"), F.col("s.average"), k1, b)).alias("score"))


def prefix(df: DataFrame, key: str, field: str, start: str) -> DataFrame:
    return expanded(df, key, field, lambda t: t.startswith(start.lower()))


def fuzzy(df: DataFrame, key: str, field: str, term: str, max_edits: int = 2, prefix_length: int = 0) -> DataFrame:
    term = term.lower()
    return expanded(df, key, field, lambda t: t.startswith(term[:prefix_length]) & (F.levenshtein(t, F.lit(term), max_edits) >= 0))


def cosine(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    norm = F.sqrt(total(F.transform(v, lambda x: x * x))) * float(sum(x * x for x in query)) ** 0.5
    return F.when(norm > 0, total(F.zip_with(v, q, lambda a, b: a * b)) / norm).otherwise(0.0)


def knn(df: DataFrame, vector: str, query: list[float], k: int, key: str) -> DataFrame:
    """The k rows nearest to a vector by cosine; each partition keeps k at most."""
    return df.withColumn("score", cosine(F.col(vector), query)).orderBy(F.desc("score"), key).limit(k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, key: str, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """Joins two top lists of (key, score): each is scaled to 0..1 by its own extremes (1 where they are equal), a missing side counts as 0.

    The lists are the k best rows of two searches, so the extremes come from a window over each; neither is computed twice."""
    whole = Window.partitionBy(F.lit(0))

    def scaled(df: DataFrame, name: str) -> DataFrame:
        e = df.select(key, "score", F.min("score").over(whole).alias("lo"), F.max("score").over(whole).alias("hi"))
        return e.select(key, F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias(name))

    both = scaled(text_hits, "text_score").join(scaled(vector_hits, "vector_score"), key, "full_outer")
    return both.fillna(0.0, ["text_score", "vector_score"]).withColumn("score", text_weight * F.col("text_score") + (1 - text_weight) * F.col("vector_score"))


def decayed(score: Column, moment: Column, as_of: str, half_life_seconds: float) -> Column:
    """The score halves with each half-life of age; the future counts as now."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(moment.cast("timestamp"))
    return score * F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life_seconds)


_PIECE = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|(?:(\w+):)?(?:"([^"]*)"|([^\s()"]+)))')


def query_string(query: str, default: str) -> Column:
    """A predicate from AND, OR, NOT, parentheses, field:term, "phrases" and prefixes*; words side by side are alternatives."""
    pieces = [m.groups() for m in _PIECE.finditer(query)]
    at = 0

    def peek() -> tuple | None:
        return pieces[at] if at < len(pieces) else None

    def either() -> Column:
        nonlocal at
        out = both()
        while (p := peek()) and not p[1] and p[2] != "AND":
            at += p[2] == "OR"
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = single()
        while (p := peek()) and p[2] == "AND":
            at += 1
            out = out & single()
        return out

    def single() -> Column:
        nonlocal at
        p = peek()
        if p is None:
            raise ValueError(f"the query ends too early: {query!r}")
        at += 1
        if p[2] == "NOT":
            return ~F.coalesce(single(), F.lit(False))
        if p[0]:
            out = either()
            if not (q := peek()) or not q[1]:
                raise ValueError(f"a parenthesis is open: {query!r}")
            at += 1
            return out
        if p[1] or p[2]:
            raise ValueError(f"unexpected {p[1] or p[2]}: {query!r}")
        text = F.col(p[3] or default).cast("string")
        if p[4] is not None:
            return phrase_slop(re.findall(r"\w+", p[4].lower()), text)
        word = p[5].lower()
        if word.endswith("*"):
            return F.exists(tokens(text), lambda t: t.startswith(word[:-1]))
        return F.array_contains(tokens(text), word)

    if not pieces:
        return F.lit(True)
    out = either()
    if at < len(pieces):
        raise ValueError(f"what comes after position {at} isn't understood: {query!r}")
    return out


def top(df: DataFrame, k: int, key: str, offset: int = 0) -> DataFrame:
    """The k best rows after some, ties by key."""
    ordered = df.orderBy(F.desc("score"), key)
    return (ordered.offset(offset) if offset else ordered).limit(k)


def search_after(df: DataFrame, score: float, key: str, after: object, k: int) -> DataFrame:
    """The page after a hit: lower scores, or the same score and a larger key.  Nothing before it is sorted."""
    return top(df.where((F.col("score") < score) | ((F.col("score") == score) & (F.col(key) > F.lit(after)))), k, key)


def with_total(df: DataFrame) -> DataFrame:
    """Adds total_hits, the number of matches whatever the page."""
    return df.withColumn("total_hits", df.agg(F.count("*")).scalar())
