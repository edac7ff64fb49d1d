"""The engine's queries by name over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.functions import paths
from corpusframe.functions import source as src
from corpusframe.functions import text as txt
from corpusframe.operators import codeintel, collections, extract, filters, geo, history, incremental, lineage, postings, ranking, scoring, trigrams, windows
from corpusframe.operators.filters import Box, Compound, Exists, Near, Range, Term
from corpusframe.sources.session import dealt, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"
TERMS = ["worthless", "clown", "this"]
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def bm25_sql(terms: list[str], where: str = "true", having: str = "", table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """BM25 in SQL; the common part of several oracles."""
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(terms)))
    parts = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / average)) ELSE 0 END" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""
WITH d AS (SELECT *, {TOKENS.format(text)} AS t FROM {table}),
     c AS (SELECT *, CAST(len(t) AS DOUBLE) AS dl, {tf} FROM d),
     s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS average, {df} FROM c),
     hits AS (SELECT {key}, {parts} AS score FROM c, s WHERE ({some}) AND ({where}) {having})
"""


# --- ranked retrieval ---------------------------------------------------------------------------------------------------------------


@query(bm25_sql(TERMS) + "SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, doc_id LIMIT 10")
def bm25_search(spark, d):
    return _score(scoring.top(scoring.bm25(_t(spark, d, "documents"), TERMS, ["text"]).select("doc_id", "score"), 10, "doc_id"))


@query(bm25_sql(TERMS, "lang = 'en' AND n_chars BETWEEN 200 AND 5000") + "SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, doc_id LIMIT 20")
def bm25_filtered(spark, d):
    keep = filters.conjunction([Term("lang", "en"), Range("n_chars", 200, 5000)])
    return _score(scoring.top(scoring.bm25(_t(spark, d, "documents"), TERMS, ["text"], keep).select("doc_id", "score"), 20, "doc_id"))


@query(bm25_sql(TERMS) + "SELECT doc_id, round(score, 6) AS score FROM hits WHERE score >= 2.0")
def bm25_min_score(spark, d):
    return _score(scoring.bm25(_t(spark, d, "documents"), TERMS, ["text"], min_score=2.0).select("doc_id", "score"))


@query(bm25_sql(TERMS) + "SELECT doc_id, round(score, 6) AS score FROM hits")
def bm25_indexed(spark, d):
    """From a term table, as a collection's index has it; all matches."""
    docs = _t(spark, d, "documents")
    return _score(postings.bm25(postings.postings(docs, "doc_id", ["text"]), postings.lengths(docs, "doc_id", ["text"]), TERMS, "doc_id", ["text"]))


@query(
    f"""
WITH w AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most FROM tf GROUP BY term
"""
)
def term_postings(spark, d):
    found = postings.postings(_t(spark, d, "documents"), "doc_id", ["text"])
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.max("tf").cast("long").alias("most"))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 50")
def match_all_filter(spark, d):
    return scoring.top(scoring.bm25(_t(spark, d, "documents"), "", ["text"], F.col("lang") == "fr").select("doc_id", "score"), 50, "doc_id")


@query(bm25_sql(["of", "the"]) + "SELECT count(*) AS total_hits FROM hits")
def total_hits(spark, d):
    return scoring.bm25(_t(spark, d, "documents"), ["of", "the"], ["text"]).agg(F.count("*").alias("total_hits"))


_PHRASE = """
WITH d AS (SELECT doc_id, {t} AS t FROM documents),
     p AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM d)
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.w = 'of' AND b.w = 'the' AND b.i - a.i BETWEEN 1 AND {reach}
"""


@query(_PHRASE.format(t=TOKENS.format("text"), reach=1))
def phrase_query(spark, d):
    return scoring.phrase(_t(spark, d, "documents"), "of the", "text").select("doc_id")


@query(_PHRASE.format(t=TOKENS.format("text"), reach=3))
def phrase_slop(spark, d):
    return scoring.phrase(_t(spark, d, "documents"), "of the", "text", slop=2).select("doc_id")


def _expanded_sql(test: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents),
     s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS average FROM d),
     w AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl, unnest(t) AS term FROM d),
     tf AS (SELECT doc_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM w WHERE {test} GROUP BY ALL),
     df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / average))), 6) AS score
FROM tf JOIN df USING (term), s GROUP BY doc_id
"""


@query(_expanded_sql("starts_with(term, 'worth')"))
def prefix_query(spark, d):
    return _score(scoring.prefix(_t(spark, d, "documents"), "doc_id", "text", "worth"))


@query(_expanded_sql("starts_with(term, 'c') AND levenshtein(term, 'clown') <= 1"))
def fuzzy_query(spark, d):
    return _score(scoring.fuzzy(_t(spark, d, "documents"), "doc_id", "text", "clown", max_edits=1, prefix_length=1))


@query(
    rf"""
WITH d AS (SELECT doc_id, lang, {TOKENS.format("text")} AS t FROM documents)
SELECT doc_id FROM d WHERE ((list_contains(t, 'idiot') OR list_contains(t, 'clown')) AND list_contains({TOKENS.format("lang")}, 'en'))
   AND NOT len(list_filter(t, lambda x: starts_with(x, 'pathe'))) > 0
"""
)
def query_string(spark, d):
    return _t(spark, d, "documents").where(scoring.query_string("(idiot OR clown) AND lang:en AND NOT pathe*", "text")).select("doc_id")


def _index(spark, d):
    """The term index of all documents, written and opened: postings with places, lengths."""
    folder, docs = new_folder(spark, "terms"), _t(spark, d, "documents")
    index = postings.written(postings.postings(docs, "doc_id", ["text"], places=True), f"{folder}/postings", "term", "doc_id")
    return folder, index, postings.written(postings.lengths(docs, "doc_id", ["text"]), f"{folder}/lengths", "doc_id")


@query(_PHRASE.format(t=TOKENS.format("text"), reach=1))
def phrase_indexed(spark, d):
    return postings.phrase(_index(spark, d)[1], "of the", "doc_id", "text")


@query(_PHRASE.format(t=TOKENS.format("text"), reach=3))
def phrase_slop_indexed(spark, d):
    return postings.phrase(_index(spark, d)[1], "of the", "doc_id", "text", slop=2)


_PATTERN = "worth(y|less)|cl[ao]wns?|[ ]id(io|ea)t"


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_PATTERN}')")
def grep_indexed(spark, d):
    """A regular expression over all texts, by an index of trigrams; only the texts of candidates are tested."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    index = postings.written(trigrams.postings(docs, "doc_id", "text"), new_folder(spark, "trigrams"), "gram", "doc_id")
    return trigrams.grep(docs, index, "doc_id", "text", _PATTERN).select("doc_id")


@query(_expanded_sql("starts_with(term, 'worth')"))
def prefix_indexed(spark, d):
    _, index, sizes = _index(spark, d)
    return _score(postings.prefix(index, sizes, "doc_id", "text", "worth"))


@query(_expanded_sql("levenshtein(term, 'clown') <= 2"))
def fuzzy_indexed(spark, d):
    """Two edits, by the dictionary of deletions; the vocabulary is that of the index."""
    folder, index, sizes = _index(spark, d)
    dictionary = postings.written(postings.neighbourhood(postings.vocabulary(index)), f"{folder}/dictionary", "rest", "term")
    return _score(postings.fuzzy(index, sizes, dictionary, "doc_id", "text", "clown", max_edits=2))


@query("SELECT event_id, round(value * pow(0.5, greatest(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts)), 0) / 604800.0), 6) AS score FROM events")
def recency_decay(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(scoring.decayed(F.col("value"), F.col("ts"), AS_OF, 604_800.0), 6).alias("score"))


_COSINE = "list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


def _vector(vectors: DataFrame, vec_id: int = 7) -> list[float]:
    return [float(x) for x in vectors.where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


@query(f"SELECT vec_id, round({_COSINE}, 5) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) ORDER BY {_COSINE} DESC, vec_id LIMIT 10")
def knn_search(spark, d):
    vectors = _t(spark, d, "embeddings")
    return scoring.knn(vectors, "embedding", _vector(vectors), 10, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


@query(
    bm25_sql(TERMS)
    + f""",
     t AS (SELECT doc_id, score FROM hits ORDER BY score DESC, doc_id LIMIT 20),
     v AS (SELECT vec_id AS doc_id, {_COSINE} AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) ORDER BY {_COSINE} DESC, vec_id LIMIT 20),
     ts AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS a FROM t),
     vs AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS b FROM v)
SELECT doc_id, round(0.4 * coalesce(a, 0) + 0.6 * coalesce(b, 0), 4) AS score FROM ts FULL JOIN vs USING (doc_id)
"""
)
def hybrid_search(spark, d):
    docs, vectors = _t(spark, d, "documents"), _t(spark, d, "embeddings")
    t = scoring.top(scoring.bm25(docs, TERMS, ["text"]).select("doc_id", "score"), 20, "doc_id")
    v = scoring.knn(vectors, "embedding", _vector(vectors), 20, "vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    return scoring.hybrid(t, v, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


# --- filters and projection -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3'")
def term_filter(spark, d):
    return filters.where(_t(spark, d, "documents"), [Term("lang", "de"), Term("lang", "fr"), Term("source", "src3")]).select("doc_id", "lang")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate >= TIMESTAMP '1996-01-01'")
def range_filter(spark, d):
    return filters.where(_t(spark, d, "orders"), [Range("o_totalprice", "1000", "50000"), Range("o_orderdate", "1996-01-01", "")]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 20")
def range_filter_exclusive(spark, d):
    return filters.where(_t(spark, d, "part"), [Range("p_size", 10, 20, True, True)]).select("p_partkey")


@query("SELECT count(*) FILTER (text IS NOT NULL AND text != '') AS present, count(*) FILTER (NOT (lang IS NOT NULL AND lang != '')) AS absent FROM documents")
def exists_filter(spark, d):
    docs = _t(spark, d, "documents")
    return docs.agg(F.count_if(Exists("text").predicate()).alias("present"), F.count_if(Exists("lang", False).predicate()).alias("absent"))


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND (p_brand = 'Brand#11' OR p_type LIKE 'STANDARD%' OR p_retailprice < 950) AND NOT coalesce(p_size > 40, false)")
def compound_filter(spark, d):
    class _Like:
        @staticmethod
        def predicate():
            return F.col("p_type").startswith("STANDARD")

    f = Compound(must=(Range("p_size", 5),), should=(Term("p_brand", "Brand#11"), _Like, Range("p_retailprice", None, 950, max_exclusive=True)), must_not=(Range("p_size", 40, None, True),))
    return _t(spark, d, "part").where(f.predicate()).select("p_partkey")


_POINTS = "SELECT c_custkey AS id, CAST(c_custkey * 37 % 180 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 53 % 360 - 180 AS DOUBLE) AS lon FROM customer"
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(48.0)) / 2), 2) + cos(radians(lat)) * cos(radians(48.0)) * pow(sin((radians(lon) - radians(11.0)) / 2), 2))))"


def _points(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(k.alias("id"), (k * 37 % 180 - 90).cast("double").alias("lat"), (k * 53 % 360 - 180).cast("double").alias("lon"))


@query(f"SELECT id FROM ({_POINTS}) WHERE {_HAVERSINE} <= 4000000.5")
def geo_distance(spark, d):
    return _points(spark, d).where(Near("lat", "lon", 48.0, 11.0, 4_000_000.5).predicate()).select("id")


@query(f"SELECT id FROM ({_POINTS}) WHERE lat BETWEEN -20 AND 40 AND (lon >= 150 OR lon <= -140)")
def geo_bbox(spark, d):
    return _points(spark, d).where(Box("lat", "lon", 40, 150, -20, -140).predicate()).select("id")


_NEAREST = f"SELECT id, round({_HAVERSINE} / 1000, 3) AS km FROM ({_POINTS}) ORDER BY round({_HAVERSINE} / 1000, 3), id LIMIT 25"


@query(_NEAREST)
def geo_sort(spark, d):
    km = F.round(filters.haversine(F.col("lat"), F.col("lon"), 48.0, 11.0) / 1000, 3)
    return _points(spark, d).select("id", km.alias("km")).orderBy("km", "id").limit(25)


def _cells(spark, d):
    points = _points(spark, d).withColumn("cell", geo.cell(F.col("lat"), F.col("lon")))
    return postings.written(points, new_folder(spark, "cells"), "cell", "id")


@query(f"SELECT id FROM ({_POINTS}) WHERE {_HAVERSINE} <= 4000000.5")
def geo_distance_cells(spark, d):
    return geo.within(_cells(spark, d), Near("lat", "lon", 48.0, 11.0, 4_000_000.5)).select("id")


@query(f"SELECT id FROM ({_POINTS}) WHERE lat BETWEEN -20 AND 40 AND (lon >= 150 OR lon <= -140)")
def geo_bbox_cells(spark, d):
    return geo.within(_cells(spark, d), Box("lat", "lon", 40, 150, -20, -140)).select("id")


@query(_NEAREST)
def geo_nearest_cells(spark, d):
    return geo.nearest(_cells(spark, d), "lat", "lon", 48.0, 11.0, 25, "id").select("id", "km")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id = 17 GROUP BY user_id")
def tenant_count(spark, d):
    return filters.tenant(_t(spark, d, "events"), 17, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE (event_id % 3 = 0) OR epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts)) < 86400 * (event_id % 30 + 1)")
def ttl_filter(spark, d):
    ttl = F.when(F.col("event_id") % 3 != 0, 86_400 * (F.col("event_id") % 30 + 1))
    return _t(spark, d, "events").where(filters.alive(F.col("ts"), ttl, AS_OF)).select("event_id")


@query("SELECT page_id, url FROM pages")
def source_projection(spark, d):
    return _t(spark, d, "pages").select("page_id", "url")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_valid(props) THEN NULL ELSE props END AS raw FROM events")
def json_source(spark, d):
    parsed = F.from_json("props", "k long, _raw string", {"columnNameOfCorruptRecord": "_raw"})
    return _t(spark, d, "events").withColumn("p", parsed).select("event_id", F.col("p.k").alias("k"), F.col("p._raw").alias("raw"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 34, 999999999)")
def lookup_keys(spark, d):
    return collections.lookup(_t(spark, d, "documents"), "doc_id", [3, 5, 8, 13, 21, 34, 999_999_999]).select("doc_id", "source")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10")
def count_filtered(spark, d):
    return filters.where(_t(spark, d, "lineitem"), [Term("l_returnflag", "R"), Range("l_quantity", 10)]).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate DESC NULLS LAST, l_extendedprice ASC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 100")
def sort_multi(spark, d):
    return _t(spark, d, "lineitem").orderBy(F.desc_nulls_last("l_shipdate"), "l_extendedprice", "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    return scoring.top(_t(spark, d, "orders").withColumn("score", F.col("o_totalprice")), 20, "o_orderkey", offset=40).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 100) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def search_after(spark, d):
    return scoring.search_after(_t(spark, d, "orders").withColumn("score", F.col("o_totalprice")), 200_000.0, "o_orderkey", 100, 20).select("o_orderkey", "o_totalprice")


# --- facets, completion, ranking, highlighting ----------------------------------------------------------------------------------------


@query(
    """
WITH p AS (SELECT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
     c AS (SELECT facet, value, count(*) AS count FROM p WHERE value IS NOT NULL AND value != '' GROUP BY ALL)
SELECT facet, value, count FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS r FROM c) WHERE r <= 10
"""
)
def facet_counts(spark, d):
    return ranking.facets(_t(spark, d, "part"), ["p_brand", "p_type", "p_size"], 10)


@query("SELECT 'p_name' AS field, p_name AS text, count(*) AS weight FROM part WHERE starts_with(lower(p_name), 'b') GROUP BY p_name ORDER BY weight DESC, text LIMIT 10")
def autocomplete_prefix(spark, d):
    return ranking.complete(_t(spark, d, "part"), ["p_name"], "B", 10)


@query("SELECT 'p_name' AS field, p_name AS text, count(*) AS weight FROM part WHERE levenshtein(left(lower(p_name), 3), 'bla') <= 1 GROUP BY p_name ORDER BY weight DESC, text LIMIT 10")
def autocomplete_fuzzy(spark, d):
    return ranking.complete(_t(spark, d, "part"), ["p_name"], "bla", 10, fuzzy=True)


_VALUES_NAMED = "SELECT field, text, count(*) AS weight FROM (SELECT 'p_name' AS field, p_name AS text FROM part UNION ALL SELECT 'p_type', p_type FROM part) WHERE {0} GROUP BY ALL ORDER BY weight DESC, text, field LIMIT 10"


def _completions(spark, d):
    return ranking.written_completions(ranking.completions(_t(spark, d, "part"), ["p_name", "p_type"]), new_folder(spark, "completions"))


@query(_VALUES_NAMED.format("starts_with(lower(text), 's')"))
def autocomplete_table(spark, d):
    return ranking.completed(_completions(spark, d), "S")


@query(_VALUES_NAMED.format("levenshtein(left(lower(text), 3), 'bla') <= 1"))
def autocomplete_table_fuzzy(spark, d):
    return ranking.completed(_completions(spark, d), "bla", fuzzy=True)


_HITS = """
h AS (SELECT p_partkey, p_name, p_type, 1.0 / (1 + p_size) AS base,
      CASE p_partkey % 4 WHEN 0 THEN 'src/main/' || p_name || '.java' WHEN 1 THEN 'src/test/' || p_name || '.java' WHEN 2 THEN 'lib/' || p_brand || '.java' ELSE 'Tests/x/' || p_brand || '.java' END AS path,
      CASE WHEN p_partkey % 5 = 0 THEN 'class' ELSE 'method' END AS kind, CASE WHEN p_partkey % 10 = 0 THEN 'Outer' ELSE '' END AS parent FROM part),
r AS (SELECT *, list_has_any(string_split(lower(path), '/'), ['test', 'tests']) AS is_test,
      (lower(trim(p_name)) = 'QQ' OR string_split(lower(trim(p_name)), '.')[-1] = 'QQ') AS named,
      (lower(path) = 'QQ' OR ends_with(lower(path), '/QQ') OR regexp_replace(string_split(lower(path), '/')[-1], '\\.[^./]+$', '') = 'QQ') AS pathed FROM h)
SELECT p_partkey, round(greatest(base * (CASE WHEN named THEN 2.0 ELSE 1.0 END) * (CASE WHEN pathed THEN 1.5 ELSE 1.0 END) * (CASE WHEN is_test THEN 0.7 ELSE 1.3 END) * (CASE WHEN kind = 'class' AND parent = '' THEN 1.2 ELSE 1.0 END), 0.0001), 6) AS score FROM r
"""
_NAME = "large bolt"


def _hits(spark, d):
    k = F.col("p_partkey")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("src/main/"), "p_name", F.lit(".java"))).when(k % 4 == 1, F.concat(F.lit("src/test/"), "p_name", F.lit(".java"))).when(k % 4 == 2, F.concat(F.lit("lib/"), "p_brand", F.lit(".java"))).otherwise(F.concat(F.lit("Tests/x/"), "p_brand", F.lit(".java")))
    )
    return _t(spark, d, "part").select("p_partkey", "p_name", path.alias("path"), F.when(k % 5 == 0, "class").otherwise("method").alias("kind"), F.when(k % 10 == 0, "Outer").otherwise("").alias("parent"), (1.0 / (1 + F.col("p_size"))).alias("score"))


@query("WITH " + _HITS.replace("QQ", _NAME))
def rerank_boosts(spark, d):
    return _score(ranking.rerank(_hits(spark, d), _NAME, "p_partkey", ["p_name"], "path", "kind", "parent").select("p_partkey", "score"))


@query("WITH " + _HITS.replace("QQ", _NAME) + " WHERE NOT is_test")
def rerank_exclude_tests(spark, d):
    return _score(ranking.rerank(_hits(spark, d), _NAME, "p_partkey", ["p_name"], "path", "kind", "parent", exclude_tests=True).select("p_partkey", "score"))


@query("SELECT event_id, round(greatest(value * CASE WHEN floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts))) / 86400) <= 7 THEN 1.15 ELSE 1.0 END, 0.0001), 6) AS score FROM events")
def rerank_recent(spark, d):
    hits = _t(spark, d, "events").withColumn("score", F.col("value"))
    return _score(ranking.rerank(hits, "", "event_id", [], moments=["ts"], as_of=AS_OF).select("event_id", "score"))


@query("SELECT doc_id, md5(regexp_replace(text, '(worthless|clown)', '**\\1**', 'gi')) AS shown FROM documents WHERE regexp_matches(text, '(worthless|clown)', 'i')")
def highlight_terms(spark, d):
    docs = _t(spark, d, "documents").where(F.col("text").rlike("(?i)(worthless|clown)"))
    return docs.select("doc_id", F.md5(ranking.marked(F.col("text"), "worthless clown the")).alias("shown"))


_FIND = "(?i)worthless|clown"
_PLACES = f"""
WITH d AS (SELECT doc_id, text, regexp_split_to_array(text, '{_FIND}') AS g, regexp_extract_all(text, '{_FIND}') AS m FROM documents),
     p AS (SELECT doc_id, text, list_transform(range(1, len(m) + 1), lambda k: [list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0),
       list_sum(list_transform(g[1:k], lambda x: len(x))) + list_sum(list_transform(m[1:k], lambda x: len(x)))]) AS places FROM d),
     s AS (SELECT doc_id, text, list_filter(list_transform(places, lambda x: [greatest(x[1] - 50, 0), least(x[2] + 50, len(text))]),
       lambda x, i: i = 1 OR greatest(places[i][1] - 50, 0) // 50 <> greatest(places[i - 1][1] - 50, 0) // 50)[1:3] AS spans FROM p)
"""


@query(
    _PLACES
    + f"""SELECT doc_id, CASE WHEN len(spans) = 0 THEN [left(text, 300)] ELSE list_transform(spans, lambda x: CASE WHEN x[1] > 0 THEN '...' ELSE '' END
  || regexp_replace(substr(text, CAST(x[1] + 1 AS BIGINT), CAST(x[2] - x[1] AS BIGINT)), '({_FIND})', '**\\1**', 'g') || CASE WHEN x[2] < len(text) THEN '...' ELSE '' END) END AS snippets FROM s"""
)
def highlight_snippets(spark, d):
    return _t(spark, d, "documents").select("doc_id", ranking.snippets(F.col("text"), "worthless clown").alias("snippets"))


_STOPS = ", ".join(f"'{w}'" for w in txt.STOP_WORDS)


@query(f"SELECT item_id, list_filter({TOKENS.format('text')}, lambda x: len(x) > 1 AND x NOT IN ({_STOPS})) AS tokens FROM benchmark")
def query_tokens(spark, d):
    return _t(spark, d, "benchmark").select("item_id", txt.query_tokens(F.col("text")).alias("tokens"))


# --- chunking, files, responses ---------------------------------------------------------------------------------------------------------

WINDOWS_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
     c AS (SELECT doc_id, len(l) AS n, list_transform(range(0, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: len(x) + 1))) AS p0 FROM d),
     q AS (SELECT doc_id, n, list_transform(p0, lambda x: coalesce(x, 0)) AS p FROM c),
     w AS (
       SELECT doc_id, n, p, 0 AS part, 0 AS s, CAST(greatest(1, least(n, coalesce(list_position(list_transform(p, lambda x: x >= 2000), true), n + 1) - 1)) AS BIGINT) AS e FROM q
       UNION ALL
       SELECT doc_id, n, p, part + 1, s2, CAST(greatest(s2 + 1, least(n, coalesce(list_position(list_transform(p, lambda x: x >= p[s2 + 1] + 2000), true), n + 1) - 1)) AS BIGINT)
       FROM (SELECT *, CAST(CASE WHEN j > s AND j < e THEN j ELSE s + 1 END AS BIGINT) AS s2 FROM (SELECT *, len(list_filter(p, lambda x: x <= p[e + 1] - 200)) - 1 AS j FROM w WHERE e < n))
     )
"""


@query(WINDOWS_SQL + "SELECT doc_id, CAST(part AS INT) AS part, CAST(s + 1 AS INT) AS line_start, CAST(e AS INT) AS line_end, CAST(p[e + 1] - p[s + 1] - 1 AS INT) AS n_chars FROM w")
def chunk_windows(spark, d):
    return windows.windows(_t(spark, d, "documents"), "doc_id", "text")


@query(
    WINDOWS_SQL
    + """, k AS (SELECT *, CAST(floor((p[e + 1] - p[s + 1] - 1 + len('// src/' || doc_id || '.txt') + 1) / 4) AS INT) AS token_count FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT) AS part, CAST(s + 1 AS INT) AS line_start, CAST(e AS INT) AS line_end, token_count FROM k WHERE token_count >= 50
"""
)
def chunk_text_blocks(spark, d):
    prefix = F.concat(F.lit("// src/"), F.col("doc_id").cast("string"), F.lit(".txt\n"))
    return windows.text_blocks(_t(spark, d, "documents"), "doc_id", "text", prefix)


@query("SELECT doc_id, CAST(floor(len(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", txt.token_estimate(F.col("text")).alias("tokens"))


@query(
    """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS line FROM d)
SELECT doc_id, CAST(line AS INT) AS line, CASE WHEN line BETWEEN 3 AND 5 THEN '>' ELSE ' ' END || ' ' || lpad(CAST(line AS VARCHAR), 5, ' ') || ' | ' || rtrim(content) AS shown FROM x WHERE line BETWEEN 1 AND 7
"""
)
def context_window(spark, d):
    return windows.context(_t(spark, d, "documents"), "doc_id", "text", 3, 5, 2)


@query("SELECT 'docs/' || doc_id || '.MD' AS path, doc_id || '.MD' AS filename, 'md' AS extension, 'docs' AS module, CAST(len(string_split(text, chr(10))) AS INT) AS loc FROM documents")
def file_metadata(spark, d):
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".MD"))
    return _t(spark, d, "documents").select(*windows.file_row(path, F.col("text"))).drop("id")


@query("SELECT lang, count(*) AS files, sum(n_chars) AS chars FROM documents GROUP BY lang")
def language_census(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS authors FROM orders GROUP BY o_orderstatus")
def index_stats(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("authors"))


@query("SELECT count(*) AS doc_count FROM documents")
def collection_stats(spark, d):
    return collections.statistics(_t(spark, d, "documents")).select("doc_count")


@query(
    """
SELECT doc_id, CASE WHEN len(text) <= 1000 THEN md5(text) ELSE md5(text[1:cut] || chr(10) || chr(10) || '... (' || CAST(len(text) - cut AS VARCHAR) || ' more characters not shown)') END AS shown
FROM (SELECT *, CASE WHEN contains(head, chr(10)) AND 1000 - strpos(reverse(head), chr(10)) > 800 THEN 1000 - strpos(reverse(head), chr(10)) ELSE 1000 END AS cut
      FROM (SELECT doc_id, text, text[1:1000] AS head FROM documents))
"""
)
def truncate_response(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(txt.truncated(F.col("text"), 1000)).alias("shown"))


# --- paths and source texts, made of the keys of whole tables --------------------------------------------------------------------------


def _made(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """Columns by SQL expressions over the key, which DuckDB reads the same way."""
    return df.select(*[F.expr(sql.format(k=key)).alias(name) for name, sql in columns.items()])


def _made_sql(table: str, key: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f"{sql.format(k=key)} AS {name}" for name, sql in columns.items()) + f" FROM {table})"


def _text(*parts: str) -> str:
    """A SQL expression that joins texts and expressions (in braces after a #) of the key."""
    out = []
    for part in parts:
        for k, piece in enumerate(re.split(r"#\[([^\]]*)\]", part)):
            if piece:
                out.append(f"CAST({piece} AS STRING)" if k % 2 else "'" + piece.replace("'", "''") + "'")
    return "concat(" + ", ".join(out) + ")"


PATHS = ["app/core/src/main/java/a/B.java", "src/x.py", "tools/run.SH", "README.md", "a/node_modules/b.js", "lib/tests/T.java", "x/build/y.gradle", "pkg/z.tar", "../up.py", "/abs.py", "web/App.tsx", "Makefile"]
_EACH_PATH = {"path": "replace(CASE {k} % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS)) + " END, 'a', concat('a', {k}))"}
_PATHS = _made_sql("part", "p_partkey", _EACH_PATH) + " AS v"


def _paths(spark, d):
    return _made(_t(spark, d, "part"), "p_partkey", **_EACH_PATH)


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(
    rf"""
SELECT path, CASE WHEN list_position(string_split(path, '/'), 'src') > 1 THEN array_to_string(string_split(path, '/')[1:list_position(string_split(path, '/'), 'src') - 1], '/')
  WHEN contains(path, '/') AND NOT list_contains(string_split(path, '/'), 'src') THEN string_split(path, '/')[1] ELSE '' END AS module,
  list_contains({_LIST(paths.SUFFIXES)}, lower(regexp_extract(path, '(\.[^./]+)$', 1))) AS indexable,
  list_has_any(string_split(path, '/'), {_LIST(paths.SKIPPED_PARTS)}) OR list_contains({_LIST(paths.SKIPPED_SUFFIXES)}, lower(regexp_extract(path, '(\.[^./]+)$', 1))) AS skipped,
  list_has_any(string_split(lower(path), '/'), ['test', 'tests']) AS is_test,
  NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS contained
FROM {_PATHS}
"""
)
def module_extract(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("path", paths.module(p).alias("module"), paths.indexable(p).alias("indexable"), paths.skipped(p).alias("skipped"), paths.is_test(p).alias("is_test"), paths.contained(p).alias("contained"))


#: A Java file for each part: its path and text, and what they hold.
_JAVA = {
    "path": _text("mod#[{k} % 5]/src/main/java/com/acme/p#[{k} % 20]/Part#[{k}].java"),
    "content": _text(
        "package com.acme.p#[{k} % 20];", "\n\n", "import com.acme.p#[{k} * 7 % 20].Part#[{k} * 7 % 500];", "\n", "import static com.acme.util.Text.trim;", "\n", "import com.acme.model.*;", "\n\n",
        "public class Part#[{k}] extends Part#[{k} % 97] implements Runnable, Item#[{k} % 9] {{", "\n", "  private Box#[{k} % 11] box;", "\n", "  public void run(Part#[{k} % 13] other) {{ trim(null); }}", "\n}}\n",
    ),
}
_SOURCES = _made_sql("part", "p_partkey", _JAVA) + " AS v"


def _sources(spark, d):
    return _made(_t(spark, d, "part"), "p_partkey", **_JAVA)


_IMPORTS = r"regexp_extract_all(content, '(?m)^\s*import\s+(?:static\s+)?([\p{L}\p{N}_$.*]+)\s*;', 1)"


@query(f"SELECT path, {_IMPORTS} AS imports FROM {_SOURCES}")
def import_extract(spark, d):
    return _sources(spark, d).select("path", src.java_imports(F.col("content")).alias("imports"))


@query(f"SELECT path, list_sort(list_distinct(list_transform({_IMPORTS}, lambda i: array_to_string(string_split(i, '.')[1:3], '.')))) AS prefixes FROM {_SOURCES}")
def import_prefixes(spark, d):
    return _sources(spark, d).select("path", src.import_prefixes(src.java_imports(F.col("content"))).alias("prefixes"))


@query(rf"SELECT path, regexp_extract(content, '(?m)^\s*package\s+([\p{{L}}\p{{N}}_$.]+)\s*;', 1) AS package FROM {_SOURCES}")
def package_extract(spark, d):
    return _sources(spark, d).select("path", src.java_package(F.col("content")).alias("package"))


_MODIFIERS = ["public static", "protected final", "private", "", "static", "final public"]
_MODIFIED = {"id": "{k}", "modifiers": "CASE {k} % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODIFIERS)) + " END"}


@query(
    "SELECT id, CASE WHEN contains(modifiers, 'public') THEN 'public' WHEN contains(modifiers, 'protected') THEN 'protected' WHEN contains(modifiers, 'private') THEN 'private' ELSE 'package-private' END AS visibility FROM "
    + _made_sql("part", "p_partkey", _MODIFIED)
)
def visibility_java(spark, d):
    return _made(_t(spark, d, "part"), "p_partkey", **_MODIFIED).select("id", src.java_visibility(F.col("modifiers")).alias("visibility"))


#: A declaration's language, name and first line, and how visible that makes it.
_NAMED = [
    ("python", "__x#", "def __x#():", "private"), ("python", "__init__", "def __init__(self):", "public"), ("python", "_y#", "def _y#():", "protected"), ("go", "Run#", "func Run#()", "public"),
    ("go", "run#", "func run#()", "private"), ("typescript", "f#", "private f#() {{", "private"), ("c_sharp", "G#", "internal void G#()", "internal"), ("rust", "h#", "fn h#()", "public"),
]


def _of_each(column: int) -> str:
    return "CASE {k} % 8 " + " ".join(f"WHEN {i} THEN replace('{x[column]}', '#', CAST({{k}} AS STRING))" for i, x in enumerate(_NAMED)) + " END"


_DECLARED = {"id": "{k}", "language": _of_each(0), "name": _of_each(1), "line": _of_each(2)}


@query("SELECT id, language, name, visibility FROM " + _made_sql("customer", "c_custkey", _DECLARED | {"visibility": _of_each(3)}))
def visibility_generic(spark, d):
    rows = _made(_t(spark, d, "customer"), "c_custkey", **_DECLARED)
    return rows.select("id", "language", "name", src.visibility(F.col("language"), F.col("name"), F.col("line")).alias("visibility"))


_SHOWN = ["id", "name", "qualified_name", "signature", "kind", "visibility", "module", "package", "parent_class", "implements", "extends_class", "line_start", "line_end", "imports", "type_references"]


def _expected(table: str, key: str, each: list[dict[str, str]]) -> str:
    """SQL for the symbols that each file of a table must give."""
    one = lambda c, x: f"CAST({x} AS INT)" if c.startswith("line") else x
    return " UNION ALL ".join("SELECT " + ", ".join(f"{one(c, x[c])} AS {c}".format(k=key) for c in _SHOWN) + f" FROM {table}" for x in each)


def _sorted_names(own: str, *names: str) -> str:
    return "array_to_string(list_sort(list_filter(list_distinct([" + ", ".join(names) + f"]), lambda x: x <> {own})), ', ')"


_CLASS, _QUALIFIED = _text("Part#[{k}]"), _text("com.acme.p#[{k} % 20].Part#[{k}]")
_JAVA_COMMON = {"module": _text("mod#[{k} % 5]"), "package": _text("com.acme.p#[{k} % 20]"), "parent_class": _CLASS, "implements": "''", "extends_class": "''", "imports": "''", "type_references": "''"}
_JAVA_SYMBOLS = [
    _JAVA_COMMON
    | {
        "id": f"concat({_JAVA['path']}, '::class::', {_QUALIFIED})", "name": _CLASS, "qualified_name": _QUALIFIED, "signature": f"concat('class ', {_CLASS})", "kind": "'class'", "visibility": "'public'", "parent_class": "''",
        "implements": _text("Runnable, Item#[{k} % 9]"), "extends_class": _text("Part#[{k} % 97]"), "line_start": "7", "line_end": "10", "imports": _text("com.acme.p#[{k} * 7 % 20].Part#[{k} * 7 % 500], com.acme.util.Text.trim, com.acme.model.*"),
        "type_references": _sorted_names(_CLASS, _text("Part#[{k} % 97]"), "'Runnable'", _text("Item#[{k} % 9]"), _text("Box#[{k} % 11]"), _text("Part#[{k} % 13]")),
    },
    _JAVA_COMMON | {"id": f"concat({_JAVA['path']}, '::field::', {_QUALIFIED}, '.box')", "name": "'box'", "qualified_name": f"concat({_QUALIFIED}, '.box')", "signature": _text("private Box#[{k} % 11] box"), "kind": "'field'", "visibility": "'private'", "line_start": "8", "line_end": "8"},
    _JAVA_COMMON
    | {"id": f"concat({_JAVA['path']}, '::method::', {_QUALIFIED}, '#run(', {_text('Part#[{k} % 13]')}, ')')", "name": "'run'", "qualified_name": f"concat({_QUALIFIED}, '#run(', {_text('Part#[{k} % 13]')}, ')')", "signature": _text("run(Part#[{k} % 13])"), "kind": "'method'", "visibility": "'public'", "line_start": "9", "line_end": "9"},
]


@query(_expected("part", "p_partkey", _JAVA_SYMBOLS))
def java_symbols(spark, d):
    return extract.symbols_of(extract.parsed(_sources(spark, d))).select(*_SHOWN)


_RUN = _text("run(Part#[{k} % 13])")
_RUN_TEXT = _text("  public void run(Part#[{k} % 13] other) {{ trim(null); }}")
_SUMMARY = _text("class Part#[{k}] extends Part#[{k} % 97] implements Runnable, Item#[{k} % 9]", "\n  public run(Part#[{k} % 13])")


@query(
    (
        f"SELECT concat({_JAVA['path']}, '::method_chunk::', {_QUALIFIED}, '#', {_RUN}) AS id, 'method' AS kind, md5(concat('// ', {_JAVA['path']}, ' :: ', {_CLASS}, ' :: ', {_QUALIFIED}, '#', {_RUN}, chr(10), ltrim({_RUN_TEXT}))) AS content, CAST(9 AS INT) AS line_start FROM part"
        f" UNION ALL SELECT concat({_JAVA['path']}, '::class_summary::', {_QUALIFIED}), 'class_summary', md5(concat('// ', {_JAVA['path']}, ' :: ', {_QUALIFIED}, chr(10), {_SUMMARY})), CAST(7 AS INT) FROM part"
    ).format(k="p_partkey")
)
def java_chunks(spark, d):
    return extract.chunks_of(extract.parsed(_sources(spark, d))).select("id", "kind", F.md5("content").alias("content"), "line_start")


_PYTHON = {
    "path": _text("pkg#[{k} % 3]/box#[{k}].py"),
    "content": _text("import os", "\nfrom lib.m#[{k} % 7] import loads\n\nLIMIT = #[{k}]\n\nclass Box#[{k}](Base#[{k} % 4]):\n    def open_#[{k} % 3](self):\n        return Thing#[{k} % 5]()\n\ndef _helper():\n    pass\n"),
}
_PYTHON_COMMON = {"visibility": "'public'", "module": _text("pkg#[{k} % 3]"), "package": "''", "parent_class": "''", "implements": "''", "extends_class": "''", "imports": "''", "type_references": "''"}
_OPEN = _text("Box#[{k}].open_#[{k} % 3]")
_PYTHON_SYMBOLS = [
    _PYTHON_COMMON | {"id": f"concat({_PYTHON['path']}, '::field::LIMIT')", "name": "'LIMIT'", "qualified_name": "'LIMIT'", "signature": _text("LIMIT = #[{k}]"), "kind": "'field'", "line_start": "4", "line_end": "4"},
    _PYTHON_COMMON
    | {
        "id": f"concat({_PYTHON['path']}, '::class::', {_text('Box#[{k}]')})", "name": _text("Box#[{k}]"), "qualified_name": _text("Box#[{k}]"), "signature": _text("class Box#[{k}](Base#[{k} % 4]):"), "kind": "'class'", "extends_class": _text("Base#[{k} % 4]"),
        "line_start": "6", "line_end": "8", "type_references": _text("Base#[{k} % 4], Thing#[{k} % 5]"),
    },
    _PYTHON_COMMON | {"id": f"concat({_PYTHON['path']}, '::method::', {_OPEN})", "name": _text("open_#[{k} % 3]"), "qualified_name": _OPEN, "signature": _text("def open_#[{k} % 3](self):"), "kind": "'method'", "parent_class": _text("Box#[{k}]"), "line_start": "7", "line_end": "8", "type_references": _text("Thing#[{k} % 5]")},
    _PYTHON_COMMON | {"id": f"concat({_PYTHON['path']}, '::function::_helper')", "name": "'_helper'", "qualified_name": "'_helper'", "signature": "'def _helper():'", "kind": "'function'", "visibility": "'protected'", "line_start": "10", "line_end": "11"},
]


@query(_expected("customer", "c_custkey", _PYTHON_SYMBOLS))
def python_symbols(spark, d):
    return extract.symbols_of(extract.parsed(_made(_t(spark, d, "customer"), "c_custkey", **_PYTHON))).select(*_SHOWN)


_GO = {
    "path": _text("cmd/m#[{k} % 3]/box#[{k}].go"),
    "content": _text('package m#[{k} % 3]\n\nimport (\n\t"fmt"\n)\n\ntype Box#[{k}] struct {{\n\tn int\n}}\n\nfunc (b *Box#[{k}]) Open() int {{\n\treturn b.n\n}}\n'),
}
_GO_COMMON = {"visibility": "'public'", "module": "'cmd'", "package": _text("m#[{k} % 3]"), "parent_class": "''", "implements": "''", "extends_class": "''", "imports": "''", "type_references": "''"}
_GO_BOX, _GO_OPEN = _text("m#[{k} % 3].Box#[{k}]"), _text("m#[{k} % 3].Open")
_GO_SYMBOLS = [
    _GO_COMMON | {"id": f"concat({_GO['path']}, '::class::', {_GO_BOX})", "name": _text("Box#[{k}]"), "qualified_name": _GO_BOX, "signature": _text("type Box#[{k}] struct {{"), "kind": "'class'", "line_start": "7", "line_end": "9"},
    _GO_COMMON | {"id": f"concat({_GO['path']}, '::function::', {_GO_OPEN})", "name": "'Open'", "qualified_name": _GO_OPEN, "signature": _text("func (b *Box#[{k}]) Open() int {{"), "kind": "'function'", "line_start": "11", "line_end": "13"},
]


@query(_expected("supplier", "s_suppkey", _GO_SYMBOLS))
def go_symbols(spark, d):
    return extract.symbols_of(extract.parsed(_made(_t(spark, d, "supplier"), "s_suppkey", **_GO))).select(*_SHOWN)


# --- code intelligence over one symbol and file for each part --------------------------------------------------------------------------

_EACH_SYMBOL = {
    "name": _text("Part#[{k}]"), "qualified_name": _QUALIFIED, "kind": "'class'", "file_path": _JAVA["path"], "line_start": "CAST(7 AS INT)", "implements": _text("Runnable, com.acme.api.Item#[{k} % 9]"), "extends_class": _text("Part#[{k} % 97]"),
    "type_references": _text("Part#[{k} % 13], Box#[{k} % 11]"), "imports": _text("com.acme.p#[{k} * 7 % 20].Part#[{k} * 7 % 500], com.acme.util.Text, com.acme.p#[{k} % 20].Part#[{k}].Inner"), "annotations": "CASE WHEN {k} % 10 = 0 THEN 'Text' ELSE '' END",
}
_EACH_FILE = {"path": _JAVA["path"], "package": _text("com.acme.p#[{k} % 20]"), "class_names": "CASE WHEN {k} % 6 = 0 THEN " + _text("Part#[{k}], Inner#[{k}]") + " ELSE " + _text("Part#[{k}]") + " END"}
_SYMBOLS = _made_sql("part", "p_partkey", _EACH_SYMBOL) + " AS s"
_FILES = _made_sql("part", "p_partkey", _EACH_FILE) + " AS f"
_SPLIT = "list_transform(string_split({0}, ','), lambda x: trim(x))"
_HAS = "len(list_filter(" + _SPLIT + ", lambda x: lower(x) = '{1}' OR lower(string_split(x, '.')[-1]) = '{1}')) > 0"


def _symbols(spark, d):
    return _made(_t(spark, d, "part"), "p_partkey", **_EACH_SYMBOL)


def _files(spark, d):
    return _made(_t(spark, d, "part"), "p_partkey", **_EACH_FILE)


def _imports(spark, d):
    # names are many times their keys, so keys are dealt out before distinct ones are looked for
    symbols = _made(dealt(_t(spark, d, "part")), "p_partkey", **_EACH_SYMBOL)
    return symbols.select("file_path", F.explode(txt.list_of(F.col("imports"))).alias("import")).distinct()


_EDGES = f"i AS (SELECT DISTINCT file_path, unnest({_SPLIT.format('imports')}) AS imp FROM {_SYMBOLS} WHERE imports != '')"


@query(f"SELECT qualified_name, CASE WHEN {_HAS.format('implements', 'item3')} THEN 'implements' ELSE 'extends' END AS relationship FROM {_SYMBOLS} WHERE {_HAS.format('implements', 'item3')} OR {_HAS.format('extends_class', 'item3')}")
def find_implementations(spark, d):
    return codeintel.find_implementations(_symbols(spark, d), "Item3").select("qualified_name", "relationship")


_REFERENCES = f"SELECT qualified_name, CASE WHEN list_contains({_SPLIT.format('type_references')}, 'Part5') THEN 'references' ELSE 'imports' END AS relationship FROM {_SYMBOLS} WHERE name != 'Part5' AND (list_contains({_SPLIT.format('type_references')}, 'Part5') OR contains(imports, 'Part5'))"


@query(_REFERENCES)
def find_references(spark, d):
    return codeintel.find_references(_symbols(spark, d), "Part5").select("qualified_name", "relationship")


@query(_REFERENCES)
def references_indexed(spark, d):
    symbols = _symbols(spark, d)
    rows = _made(dealt(_t(spark, d, "part")), "p_partkey", **_EACH_SYMBOL)  # trigrams cost far more than the keys' bytes tell
    index = postings.written(codeintel.reference_index(rows, "qualified_name"), new_folder(spark, "references"), "gram", "qualified_name")
    return codeintel.find_references(symbols, "Part5", index, "qualified_name").select("qualified_name", "relationship")


@query(
    f"""
WITH {_EDGES}, m AS (SELECT i.file_path, imp, line_start, CASE WHEN contains(extends_class, string_split(imp, '.')[-1]) THEN 'EXTENDS' WHEN contains(implements, string_split(imp, '.')[-1]) THEN 'IMPLEMENTS' WHEN contains(annotations, string_split(imp, '.')[-1]) THEN 'ANNOTATION' END AS kind
  FROM i JOIN {_SYMBOLS} ON s.file_path = i.file_path)
SELECT file_path, imp AS import, coalesce(arg_min(kind, line_start) FILTER (kind IS NOT NULL), 'IMPORT') AS type FROM m GROUP BY ALL
"""
)
def classify_imports(spark, d):
    return codeintel.classify_imports(_imports(spark, d), _symbols(spark, d))


@query(
    f"""
WITH {_EDGES}, c AS (SELECT package, unnest({_SPLIT.format('class_names')}) AS class, path FROM {_FILES}),
     x AS (SELECT file_path, imp, string_split(imp, '.') AS p FROM i)
SELECT x.file_path, imp AS import, coalesce(a.path, b.path) AS file FROM x LEFT JOIN c a ON a.package = array_to_string(p[:-2], '.') AND a.class = p[-1] LEFT JOIN c b ON b.package = array_to_string(p[:-3], '.') AND b.class = p[-2]
"""
)
def resolve_imports(spark, d):
    return codeintel.resolve_imports(_imports(spark, d), _files(spark, d))


@query(
    f"""
WITH t AS (SELECT path AS target, unnest({_SPLIT.format('class_names')}) AS class FROM {_FILES} WHERE package = 'com.acme.p3'),
     r AS (SELECT target, file_path AS file, class, CASE WHEN list_contains({_SPLIT.format('type_references')}, class) THEN 'references' ELSE 'imports' END AS via FROM t JOIN {_SYMBOLS} ON name != class
           AND (list_contains({_SPLIT.format('type_references')}, class) OR len(list_filter({_SPLIT.format('imports')}, lambda x: list_contains(string_split(x, '.'), class))) > 0) WHERE file_path != target)
SELECT target, file, class, via FROM (SELECT *, row_number() OVER (PARTITION BY target, file ORDER BY via DESC, class) AS k FROM r) WHERE k = 1
"""
)
def reverse_deps(spark, d):
    files = _files(spark, d)
    return codeintel.reverse_dependencies(_symbols(spark, d), files, files.where("package = 'com.acme.p3'").select("path"))


@query(
    """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS s, 'n' || n_nationkey AS t FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
     w AS (SELECT 'r1' AS node, 0 AS level UNION ALL SELECT t, level + 1 FROM w JOIN e ON s = node WHERE level < 2)
SELECT node, min(level) AS level FROM w GROUP BY node
"""
)
def transitive_deps(spark, d):
    a = _t(spark, d, "region").join(_t(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("r"), "r_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    b = _t(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"))
    return codeintel.transitive(a.union(b), spark.createDataFrame([("r1",)], "node string"), depth=2, most=None)


# --- history and maintenance ------------------------------------------------------------------------------------------------------------


#: Some changes are renamings.
_OLD_PATH = "CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN concat('p/', CAST(l_partkey * 13 % 200 + 1 AS STRING)) END"


def _commits(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.col("o_custkey").cast("string").alias("author_name"), F.lit("").alias("author_email"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("subject"))


def _changes(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("path"), F.expr(_OLD_PATH).alias("old_path"), F.col("l_returnflag").alias("status"), F.col("l_quantity").alias("delta"))


@query(
    """
SELECT CAST(o_orderkey AS VARCHAR) AS sha, o_orderdate AS date FROM orders WHERE regexp_matches(o_orderpriority, 'urgent', 'i') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND starts_with('p/' || l_partkey, 'p/7/') OR l_orderkey = o_orderkey AND l_partkey = 7) ORDER BY o_orderdate DESC, sha LIMIT 20
"""
)
def commit_search(spark, d):
    from datetime import datetime

    return history.search_commits(_commits(spark, d), _changes(spark, d), "urgent", since=datetime(1995, 1, 1), until=datetime(1998, 12, 31), path="p/7", limit=20).select("sha", "date")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS sha, count(*) AS files_changed, sum(l_quantity) AS delta FROM lineitem GROUP BY l_orderkey")
def commit_diff_summary(spark, d):
    return history.summary(_changes(spark, d), delta="delta")


_RENAMED = "n = 6 AND f = 'R'"
_FILE_CHANGE = {
    "sha": "CAST(l_orderkey AS STRING)",
    "path": "concat('p/', CAST(l_partkey AS STRING))",
    "old_path": f"CASE WHEN {_RENAMED} THEN concat('p/', CAST(l_partkey * 13 % 200 + 1 AS STRING)) END",
    "status": f"CASE WHEN {_RENAMED} THEN 'R' WHEN (l_orderkey + l_partkey) % 17 = 0 THEN 'D' ELSE 'M' END",
}
_FILES_BY_DATE = f"""
WITH RECURSIVE o AS (SELECT CAST(o_orderkey AS VARCHAR) AS sha, o_orderdate AS date, row_number() OVER (ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS place FROM orders),
     g AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n, arg_min(l_returnflag, l_linenumber) AS f FROM lineitem GROUP BY l_orderkey, l_partkey),
     c AS (SELECT x.*, date, place FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in _FILE_CHANGE.items())} FROM g) AS x JOIN o ON o.sha = x.sha),
     ev AS (SELECT path AS name, sha, status <> 'D' AS live, place * 4 + 2 AS t FROM c UNION ALL SELECT old_path, sha, false, place * 4 + 1 FROM c WHERE old_path <> path),
     e AS (SELECT c.sha, c.path, max({{'t': ev.t, 'sha': ev.sha, 'name': ev.name, 'live': ev.live}}) AS x FROM c JOIN ev ON ev.name = coalesce(c.old_path, c.path) AND c.place * 4 > ev.t GROUP BY c.sha, c.path),
     l AS (SELECT c.*, CASE WHEN x.live THEN x.sha END AS b_sha, CASE WHEN x.live THEN x.name END AS b_path FROM c LEFT JOIN e ON e.sha = c.sha AND e.path = c.path),
     r AS (SELECT sha, path, date, place, sha || ':' || path AS file_id FROM l WHERE b_sha IS NULL UNION ALL SELECT l.sha, l.path, l.date, l.place, r.file_id FROM r JOIN l ON l.b_sha = r.sha AND l.b_path = r.path),
     h AS (SELECT * FROM r WHERE file_id = (SELECT file_id FROM r WHERE path = 'p/12' ORDER BY place DESC LIMIT 1))
"""


def _file_changes(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"), F.min_by("l_returnflag", "l_linenumber").alias("f"))
    return g.select(*[F.expr(v).alias(k) for k, v in _FILE_CHANGE.items()])


@query(_FILES_BY_DATE + "SELECT sha, path, date, lag(sha) OVER (ORDER BY place, path) AS previous_sha FROM h ORDER BY place DESC, path DESC LIMIT 15")
def file_history(spark, d):
    """The history of one file under all its names, and of no other file that had one of them."""
    return history.file_history(_commits(spark, d), _file_changes(spark, d), "p/12").select("sha", "path", "date", "previous_sha")


@query(_FILES_BY_DATE + "SELECT path AS name, max(date) AS last FROM h GROUP BY path")
def rename_chain(spark, d):
    commits = _commits(spark, d)
    return history.names(commits, history.files_of(commits, lineage.under_names(_file_changes(spark, d), "p/12")), "p/12")


_VERSION = "concat('one', chr(10), 'line ', CAST({k} AS STRING), chr(10), 'three', chr(10))"
#: A main line of commits, of whose every ten three are on a branch, the last of them on a branch of the branch; in order of key, not of date.
_TREE_COMMIT = {
    "k": "o_orderkey",
    "parent": "CASE WHEN o_orderkey = 0 THEN NULL WHEN o_orderkey % 10 IN (0, 7) THEN o_orderkey - 4 WHEN o_orderkey % 10 = 9 THEN o_orderkey - 2 ELSE o_orderkey - 1 END",
    "chain": "CASE WHEN o_orderkey % 10 < 7 THEN 0 WHEN o_orderkey % 10 = 9 THEN -o_orderkey ELSE o_orderkey - o_orderkey % 10 + 1 END",
    "path": "concat('f/', CAST(o_custkey % 40 AS STRING))",
    "old_path": "CASE WHEN o_orderkey % 13 = 0 THEN concat('f/', CAST((o_custkey + 1) % 40 AS STRING)) END",
    "status": "CASE WHEN o_orderkey % 13 = 0 THEN 'R' WHEN o_orderkey % 11 = 0 THEN 'D' ELSE 'M' END",
    "content": _VERSION.format(k="o_orderkey"),
}
_TREE = f"""
WITH RECURSIVE c AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _TREE_COMMIT.items())} FROM orders),
     walk AS (SELECT k, coalesce(old_path, path) AS name, parent AS at FROM c WHERE parent IS NOT NULL
              UNION ALL SELECT w.k, w.name, c.parent FROM walk AS w JOIN c ON c.k = w.at WHERE c.path <> w.name AND c.old_path IS DISTINCT FROM w.name AND c.parent IS NOT NULL),
     hit AS (SELECT w.k, c.k AS b, c.path AS b_path, c.content AS before FROM walk AS w JOIN c ON c.k = w.at WHERE c.path = w.name AND c.status <> 'D'),
     l AS (SELECT c.*, b, b_path, before FROM c LEFT JOIN hit ON hit.k = c.k)
"""


def _tree(spark, d):
    """placed commits, changes and versions, by key and parent."""
    c = _t(spark, d, "orders").select(*[F.expr(v).alias(k) for k, v in _TREE_COMMIT.items()]).withColumn("sha", F.col("k").cast("string"))
    placed = c.select("sha", F.col("parent").cast("string").alias("parent"), "chain", F.col("k").alias("place"))
    return placed, c.select("sha", "path", "old_path", "status"), c.where("status != 'D'").select("sha", "path", "content")


@query(
    _TREE
    + """
SELECT CAST(k AS VARCHAR) AS sha, path, md5(CASE
  WHEN status = 'D' AND before IS NULL THEN ''
  WHEN status = 'D' THEN concat('--- a/', path, chr(10), '+++ /dev/null', chr(10), '@@ -1,3 +0,0 @@', chr(10), '-one', chr(10), '-line ', CAST(b AS STRING), chr(10), '-three')
  WHEN before IS NULL THEN concat('--- /dev/null', chr(10), '+++ b/', path, chr(10), '@@ -0,0 +1,3 @@', chr(10), '+one', chr(10), '+line ', CAST(k AS STRING), chr(10), '+three')
  ELSE concat('--- a/', coalesce(old_path, path), chr(10), '+++ b/', path, chr(10), '@@ -1,3 +1,3 @@', chr(10), ' one', chr(10), '-line ', CAST(b AS STRING), chr(10), '+line ', CAST(k AS STRING), chr(10), ' three') END) AS diff
FROM l
"""
)
def commit_diffs(spark, d):
    """The diff of each change against the version that its parent commit has, over branches, renamings and deletions."""
    placed, changes, versions = _tree(spark, d)
    return history.diffs(history.versions_of(changes, versions, changes, placed)).select("sha", "path", F.md5("diff").alias("diff"))


@query(
    _TREE
    + """, r AS (SELECT k, path, CAST(k AS VARCHAR) || ':' || path AS file_id FROM l WHERE b IS NULL UNION ALL SELECT l.k, l.path, r.file_id FROM r JOIN l ON l.b = r.k AND l.b_path = r.path)
SELECT CAST(k AS VARCHAR) AS sha, path, file_id FROM r
"""
)
def file_identity(spark, d):
    """Which file each change is of, from parent edges alone."""
    placed, changes, _ = _tree(spark, d)
    return history.files_of(None, changes, lineage.placed(placed.select("sha", "parent"))).select("sha", "path", "file_id")


_SNAPSHOTS = "b AS (SELECT p_partkey AS path, p_size AS size FROM part WHERE p_partkey % 10 != 0), a AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 11 != 0)"


def _snapshots(spark, d):
    k = F.col("p_partkey")
    part = _t(spark, d, "part")
    before = part.where(k % 10 != 0).select(k.alias("path"), F.col("p_size").alias("size"))
    return before, part.where(k % 11 != 0).select(k.alias("path"), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"))


@query(f"WITH {_SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'A' WHEN a.path IS NULL THEN 'D' ELSE 'M' END AS status FROM b FULL JOIN a ON a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.size IS DISTINCT FROM b.size")
def snapshot_diff(spark, d):
    return incremental.snapshot_diff(*_snapshots(spark, d), marks=("size",))


@query(f"WITH {_SNAPSHOTS} SELECT path, size FROM b WHERE path NOT IN (SELECT coalesce(a.path, b.path) FROM b FULL JOIN a ON a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.size IS DISTINCT FROM b.size) UNION ALL SELECT a.path, a.size FROM a LEFT JOIN b ON a.path = b.path WHERE b.path IS NULL OR a.size IS DISTINCT FROM b.size")
def apply_changes(spark, d):
    before, after = _snapshots(spark, d)
    return incremental.apply_changes(before, incremental.snapshot_diff(before, after, marks=("size",)), after, "path")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS r FROM lineitem) WHERE r = 1 AND l_returnflag != 'R'")
def upsert_latest(spark, d):
    feed = _t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return collections.apply_feed(feed, "l_partkey", "seq", "l_returnflag", "R").select("l_partkey", "l_orderkey", "l_linenumber")


_ACTION = "CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END"


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type != 'error'")
def ordered_stream(spark, d):
    """All events as a feed that comes shuffled, in four batches, a part of it twice; the stream's collection is the state after the newest of each key."""
    from corpusframe.sources.catalog import Catalog
    from corpusframe.streaming import index

    folder = new_folder(spark, "ordered-stream")
    events = _t(spark, d, "events").select("user_id", "event_id", "event_type", "value", F.expr(_ACTION).alias("action"))
    again = events.where("event_id % 10 = 3").withColumn("times", F.lit(2))
    feed = events.withColumn("times", F.lit(1)).unionByName(again).repartition(4, F.xxhash64("event_id", "times")).drop("times")
    feed.write.parquet(f"{folder}/feed")
    stream = index.change_stream(spark, f"{folder}/feed", feed.schema.simpleString()[7:-1].replace(":", " "), max_files=1)
    collection = Catalog(spark, folder, "items")
    for _ in range(2):  # the second time there is nothing new
        index.keep_current(stream, collection, "items", "user_id", "event_id", f"{folder}/checkpoint").awaitTermination()
    return collection.open("items").select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'en' AND n_chars < 1000, false)")
def delete_by_query(spark, d):
    return filters.delete_where(_t(spark, d, "documents"), [Term("lang", "en"), Range("n_chars", None, 1000, max_exclusive=True)]).select("doc_id")


@query("SELECT max(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS last_indexed, max(o_orderkey) AS current_head, max(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1998-01-01') IS DISTINCT FROM max(o_orderkey) AS is_stale FROM orders")
def staleness(spark, d):
    orders = _t(spark, d, "orders")
    return incremental.staleness(orders.where("o_orderdate < '1998-01-01'"), orders, "o_orderkey")


@query("SELECT n_nationkey AS path, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'git' WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 'unstaged' ELSE 'mtime' END AS status FROM nation")
def change_union(spark, d):
    parts = [("supplier", "s_nationkey", "git"), ("customer", "c_nationkey", "unstaged"), ("nation", "n_nationkey", "mtime")]
    return collections.prior([_t(spark, d, t).select(F.col(c).alias("path"), F.lit(s).alias("status")) for t, c, s in parts], "path")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_collections(spark, d):
    return collections.missing(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id"), "doc_id")


_ROOTS = [f"/home/u{i}" for i in range(0, 50, 2)] + [f"/home/u{i}/r3" for i in range(50)] + ["/home/u7/r3/src"]
_FOLDER = {"id": "{k}", "cwd": _text("/home/u#[{k} % 50]/r#[{k} % 7]/src")}


@query(
    "SELECT DISTINCT cwd, arg_max(root, len(root)) AS root FROM " + _made_sql("customer", "c_custkey", _FOLDER) + ", (VALUES " + ", ".join(f"('{r}')" for r in _ROOTS) + ") AS r(root) WHERE cwd = root OR starts_with(cwd, root || '/') GROUP BY cwd"
)
def repo_by_folder(spark, d):
    from corpusframe.sources import registry

    return registry.owner(registry.registry(spark, _ROOTS), _made(_t(spark, d, "customer"), "c_custkey", **_FOLDER)).select("cwd", "root")


@query("SELECT page_id, CAST(count(*) AS BIGINT) AS links, count(DISTINCT h) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages) GROUP BY page_id")
def page_links(spark, d):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", F.explode(hrefs).alias("h")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("h").alias("targets"))
