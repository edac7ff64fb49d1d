"""Re-ranking, facets, completion and highlighting over search hits."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions import paths
from corpusframe.functions.text import terms_of
from corpusframe.operators.scoring import let


@dataclass(frozen=True)
class RankingConfig:
    """Multipliers of the boosts."""

    exact_name: float = 2.0
    path: float = 1.5
    production: float = 1.3
    test: float = 0.7
    primary_class: float = 1.2
    recent: float = 1.15
    recent_days: int = 7
    floor: float = 0.0001


def _equals_name(value: Column, query: str) -> Column:
    v = F.lower(F.trim(value))
    return F.coalesce((v == query) | (F.element_at(F.split(v, r"\."), -1) == query), F.lit(False))


def exact_name(query: str, columns: list[str]) -> Column:
    """A name equals the query, or does after its last dot."""
    q = query.strip().lower()
    return reduce(lambda a, b: a | b, [_equals_name(F.col(c), q) for c in columns], F.lit(False)) if q else F.lit(False)


def path_match(query: str, path: Column) -> Column:
    """The path equals the query, ends with it as a whole part, or its file's stem equals it."""
    q, p = query.strip().lower(), F.lower(path)
    return F.coalesce((p == q) | p.endswith("/" + q) | (paths.stem(p) == q), F.lit(False)) if q else F.lit(False)


def primary_class(kind: Column, parent: Column) -> Column:
    return F.coalesce(kind.isin("class", "interface", "enum"), F.lit(False)) & (F.coalesce(parent, F.lit("")) == "")


def recent(as_of: str, days: int, *moments: Column) -> Column:
    """The first of the moments that can be read is at most some whole days old."""
    moment = F.coalesce(*[F.try_to_timestamp(m.cast("string")) for m in moments])
    age = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(moment)) / 86_400)
    return F.coalesce(age <= days, F.lit(False))


def rerank(hits: DataFrame, query: str, key: str, names: list[str], path: str | None = None, kind: str | None = None, parent: str | None = None, moments: list[str] | None = None, as_of: str | None = None, exclude_tests: bool = False, config: RankingConfig = RankingConfig()) -> DataFrame:
    """Multiplies `score` by the boosts that apply and orders by it.  With exclude_tests, test files go (after the hits were cut to top k
    if the caller did so; filter before scoring to avoid that)."""
    boost = F.when(exact_name(query, names), config.exact_name).otherwise(1.0)
    if path is not None:
        test = paths.is_test(F.col(path))
        boost = boost * F.when(path_match(query, F.col(path)), config.path).otherwise(1.0) * F.when(test, config.test).otherwise(config.production)
        if exclude_tests:
            hits = hits.where(~test)
    if kind is not None:
        boost = boost * F.when(primary_class(F.col(kind), F.col(parent) if parent else F.lit("")), config.primary_class).otherwise(1.0)
    if moments and as_of:
        boost = boost * F.when(recent(as_of, config.recent_days, *map(F.col, moments)), config.recent).otherwise(1.0)
    return hits.withColumn("score", F.greatest(F.col("score") * boost, F.lit(config.floor))).orderBy(F.desc("score"), key)


def facets(df: DataFrame, columns: list[str], count: int = 10) -> DataFrame:
    """(facet, value, count): the most frequent values of each column over all rows; null and empty values don't count.

    One aggregation over (facet, value) pairs; the ranking sees the distinct values only."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    counted = pairs.where("value IS NOT NULL AND value != ''").groupBy("facet", "value").agg(F.count("*").alias("count"))
    order = Window.partitionBy("facet").orderBy(F.desc("count"), "value")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def complete(df: DataFrame, columns: list[str], prefix: str, limit: int = 10, fuzzy: bool = False) -> DataFrame:
    """(field, text, weight): distinct values that begin with the prefix, or whose beginning is one edit away; the most frequent first."""
    q = prefix.lower()
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])).alias("p")).select("p.*")
    low = F.lower("text")
    test = F.levenshtein(F.substring(low, 1, len(q)), F.lit(q), 1) >= 0 if fuzzy else low.startswith(q)
    return pairs.where(test).groupBy("field", "text").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "text", "field").limit(limit)


COMPLETIONS = 20
LONGEST = 32


def completions(df: DataFrame, columns: list[str], most: int = COMPLETIONS, longest: int = LONGEST) -> DataFrame:
    """(n, prefix, whole, field, text, weight): of each beginning of n letters the `most` best values, and the values that end there (`whole`).

    One aggregation to values, one over their beginnings; a task ranks its own before they are shuffled, so the beginnings that most values share are
    no load.  Write it by n, sorted by prefix (`written_completions`)."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns])).alias("p")).select("p.*")
    values = pairs.where("text IS NOT NULL").groupBy("field", "text").agg(F.count("*").alias("weight"))
    low = F.lower("text")
    each = values.select("field", "text", "weight", F.explode(F.sequence(F.lit(0), F.least(F.length(low), F.lit(longest)))).alias("n"))
    begun = each.withColumn("prefix", F.substring(low, F.lit(1), F.col("n"))).withColumn("whole", F.explode(F.when(F.length(low) == F.col("n"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    best = Window.partitionBy("prefix", "whole").orderBy(F.desc("weight"), "text", "field")
    return begun.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("n", "prefix", "whole", "field", "text", "weight")


def written_completions(table: DataFrame, path: str) -> DataFrame:
    """The table on disk, a partition for each length of a beginning."""
    order = ["n", "prefix", "whole"]
    table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("n").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def completed(table: DataFrame, prefix: str, limit: int = 10, fuzzy: bool = False, most: int = COMPLETIONS, longest: int = LONGEST) -> DataFrame:
    """What `complete` gives, from a table of completions: (field, text, weight).  One partition is read, and of that the pages that hold the prefix;
    with `fuzzy` all beginnings of that length are compared, and the values that end a letter before."""
    q = prefix.lower()
    if limit > most or len(q) > longest:
        raise ValueError(f"the table has {most} values a beginning, of up to {longest} letters")
    found = table.where((F.col("n") == len(q)) & ~F.col("whole"))
    if fuzzy:
        ended = table.where((F.col("n") == len(q) - 1) & F.col("whole"))
        found = found.unionByName(ended).where(F.levenshtein("prefix", F.lit(q), 1) >= 0)
    else:
        found = found.where(F.col("prefix") == q)
    return found.select("field", "text", "weight").orderBy(F.desc("weight"), "text", "field").limit(limit)


def marked(text: Column, query: str, mark: str = "**") -> Column:
    """All occurrences of the query's terms, whatever their case, between marks."""
    terms = terms_of(query, highlight=True)
    if not terms:
        return text
    either = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?i)({either})", f"{mark}$1{mark}")


SNIPPET_CHARS, SNIPPET_CONTEXT, SNIPPETS = 300, 50, 3


def snippets_of(text: str, terms: list[str], context: int = SNIPPET_CONTEXT, most: int = SNIPPETS, whole: int = SNIPPET_CHARS) -> list[str]:
    """What `snippets` gives for one text, for a page of hits that the driver shows."""
    find = re.compile("|".join(re.escape(t) for t in terms), re.IGNORECASE) if terms else None
    out: list[str] = []
    seen: set[int] = set()
    for m in find.finditer(text) if find else ():
        start, end = max(0, m.start() - context), min(len(text), m.end() + context)
        if start // context in seen:
            continue
        seen.add(start // context)
        piece = find.sub(lambda x: f"**{x[0]}**", text[start:end])
        out.append(("..." if start else "") + piece + ("..." if end < len(text) else ""))
        if len(out) == most:
            break
    return out or [text[:whole]]


def snippets(text: Column, query: str, context: int = SNIPPET_CONTEXT, most: int = SNIPPETS, whole: int = SNIPPET_CHARS) -> Column:
    """array<string>: up to `most` pieces of the text around matches, not two from the same stretch; the text's beginning if nothing matches.

    What stands between the matches and the matches themselves have lengths, whose sums are the places; a piece's stretch never
    decreases, so those that begin a stretch are the ones whose predecessor is of another."""
    terms = terms_of(query, highlight=True)
    t = F.coalesce(text, F.lit(""))
    none = F.array(F.substring(t, 1, whole))
    if not terms:
        return none
    find = "(?iu)" + "|".join(re.escape(x) for x in terms)

    def found(x: Column) -> Column:
        def starts(lengths: Column) -> Column:
            begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("all"))
            step = lambda acc, n: F.struct((acc["at"] + n["gap"] + n["match"]).alias("at"), F.concat(acc["all"], F.array(F.struct((acc["at"] + n["gap"]).alias("a"), (acc["at"] + n["gap"] + n["match"]).alias("b")))).alias("all"))
            return F.aggregate(lengths, begin, step, lambda acc: acc["all"])

        def stretches(places: Column) -> Column:
            stretch = lambda i: F.floor(F.greatest(F.get(places, i)["a"] - context, F.lit(0)) / context)
            first = F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda i: (i == 0) | (stretch(i) != stretch(i - 1)))
            return F.transform(F.slice(first, 1, most), lambda i: F.get(places, i))

        def piece(m: Column) -> Column:
            start, end = F.greatest(m["a"] - context, F.lit(0)), F.least(m["b"] + context, F.length(x))
            shown = F.regexp_replace(F.substring(x, start + 1, end - start), f"({find})", "**$1**")
            return F.concat(F.when(start > 0, "...").otherwise(""), shown, F.when(end < F.length(x), "...").otherwise(""))

        gaps, matches = F.split(x, find, -1), F.regexp_extract_all(x, F.lit(find), F.lit(0))
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match")))
        return F.transform(let(starts(lengths), stretches), piece)

    return F.when(t.rlike(find), let(t, found)).otherwise(none)
