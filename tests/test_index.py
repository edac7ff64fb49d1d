"""Searches of stored indexes give the rows of searches of texts, and read the pages of their terms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusframe.operators import codeintel, postings, ranking, scoring

ODD = [None, "", "...", "to be or not to be, to be", "To BE be to", "a a a a", "a b a c a b", "ÜBER über straße 日本 x_1 9", "be " * 3000 + "or to", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    texts = ODD + [" ".join(r.choice("to be or not a b c bee toe nor".split()) for _ in range(r.randint(0, 30))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    return postings.written(postings.postings(docs, "id", ["text"], places=True), f"{root}/postings", "term", "id"), postings.written(postings.lengths(docs, "id", ["text"]), f"{root}/lengths", "id"), root


def test_places(docs, index):
    got = {}
    for x in index[0].collect():
        assert len(x.at) == x.tf and list(x.at) == sorted(x.at)
        for k in x.at:
            got.setdefault(x.id, {})[k] = x.term
    from corpusframe.functions.text import tokens

    want = {r.id: dict(enumerate(r.w)) for r in docs.select("id", tokens(F.col("text")).alias("w")).collect() if r.w}
    assert got == want
    plain = postings.postings(docs, "id", ["text"]).select("id", "field", "dl", "term", "tf")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, index[0].select("id", "field", "dl", "term", "tf").collect()))


@pytest.mark.parametrize("slop", [0, 1, 3])
@pytest.mark.parametrize("words", ["to be", "be to be", "a a", "a b a", "to be or not", "none here", "über", "not"])
def test_phrases(docs, index, words, slop):
    want = sorted(r.id for r in scoring.phrase(docs.where("text IS NOT NULL"), words, "text", slop).select("id").collect())
    assert sorted(r.id for r in postings.phrase(index[0], words, "id", "text", slop).collect()) == want
    assert postings.phrase(index[0], "", "id", "text", slop).count() == 0


def near_words(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("edits", "head"), [(1, 2), (1, 7), (2, 3), (2, 7)])
def test_the_dictionary_finds_every_term_within_some_edits(spark, edits, head):
    """All pairs of words over two letters, and random ones: a head longer than the edits is enough."""
    r = random.Random(head)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(250)} | {"".join(r.choice("abcdefgh") for _ in range(r.randint(5, 14))) for _ in range(50)} | {"z" * 5000})
    pairs = {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= edits and near_words(a, b) <= edits}
    heads = {w: postings.rests_of(w[:head], edits) for w in words}
    assert all(heads[a] & heads[b] for a, b in pairs)
    vocabulary = spark.createDataFrame([("f", w, k) for k, w in enumerate(words)] + [("g", "ab", 1)], "field string, term string, df long")
    dictionary = postings.neighbourhood(vocabulary, edits, head).cache()
    assert {(x.term, x.rest) for x in dictionary.where("field = 'f'").collect()} == {(w, s) for w in words for s in heads[w]}
    for word in r.sample(words, 6) + ["AB", "nothing like it"]:
        assert {x.term for x in postings.near(dictionary, "f", word, edits, head=head).collect()} == {w for w in words if near_words(w, word.lower()) <= edits}
    assert {x.term for x in postings.near(dictionary, "f", "ab", edits, prefix_length=1, head=head).collect()} == {w for w in words if near_words(w, "ab") <= edits and w[0] == "a"}


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("pushed", [1000, 1])
def test_prefixes_and_fuzzy_terms(docs, index, monkeypatch, pushed):
    monkeypatch.setattr(postings, "PUSHED", pushed)
    terms, sizes, _ = index
    dictionary = postings.neighbourhood(postings.vocabulary(terms))
    for start in ("to", "B", "none"):
        assert scores(postings.prefix(terms, sizes, "id", "text", start)) == scores(scoring.prefix(docs, "id", "text", start))
    for word, edits, first in (("bee", 1, 0), ("toe", 2, 1), ("zzzzzz", 2, 0)):
        assert scores(postings.fuzzy(terms, sizes, dictionary, "id", "text", word, edits, first)) == scores(scoring.fuzzy(docs, "id", "text", word, edits, first))


def test_searches_read_no_text_and_push_their_terms(spark, index):
    stored = spark.read.parquet(f"{index[2]}/postings")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [be,to])" in plan(postings.phrase(stored, "to be", "id", "text"))
    assert "StringStartsWith(term,to)" in plan(postings.prefix(stored, index[1], "id", "text", "to"))
    dictionary = postings.written(postings.neighbourhood(postings.vocabulary(stored)), f"{index[2]}/dictionary", "rest", "term")
    assert "In(rest, [" in plan(postings.near(dictionary, "text", "bee", 1))
    assert "text" not in stored.columns


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(11)
    rows = [(r.choice(["Parse", "parse", "parser", "Parsed", "pars", "path", "Path", "p", "", "über", "Über", None, "longer than the longest beginning of all " + str(r.randint(0, 3))]), "".join(r.choice("pars") for _ in range(r.randint(0, 5)))) for _ in range(600)]
    return spark.createDataFrame(rows, "name string, other string").repartition(3).cache()


@pytest.mark.parametrize("fuzzy", [False, True])
def test_completions(values, fuzzy, tmp_path_factory):
    table = ranking.written_completions(ranking.completions(values, ["name", "other"]), str(tmp_path_factory.mktemp("completions"))).cache()
    for prefix in ("", "p", "pa", "PAR", "pars", "parse", "parser", "parsers", "ü", "x", "ra", "longer than the longest beginnin"):
        want = list(map(tuple, ranking.complete(values.where("name IS NOT NULL"), ["name", "other"], prefix, 10, fuzzy).collect()))
        alone = ranking.complete(values, ["name", "other"], prefix, 10, fuzzy).where("text IS NOT NULL")
        assert list(map(tuple, ranking.completed(table, prefix, 10, fuzzy).collect())) == list(map(tuple, alone.collect())), (prefix, want)
    with pytest.raises(ValueError):
        ranking.completed(table, "p", 21)
    with pytest.raises(ValueError):
        ranking.completed(table, "longer than the longest beginning", 10)


def test_a_completion_reads_one_partition(spark, values, tmp_path):
    table = ranking.written_completions(ranking.completions(values, ["name"]), str(tmp_path / "c"))
    plan = ranking.completed(table, "par")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n" in plan and "EqualTo(prefix,par)" in plan
    assert ranking.completions(values.limit(0), ["name"]).count() == 0
    full = ranking.completions(values, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert full.count("WindowGroupLimit") == 2, "each task ranks before it hands on"


def test_rows_of_an_index_are_worked_out_once(spark, tmp_path):
    """Ranges take two passes over the rows; the texts must not be taken apart in both."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(500).selectExpr("concat('t', id % 7) AS term", "id AS doc_id").mapInArrow(count, "term string, doc_id long")
    table = postings.written(rows, str(tmp_path / "table"), "term", "doc_id")
    assert seen.value == 500
    assert sorted(map(tuple, table.collect())) == sorted((f"t{k % 7}", k) for k in range(500))


def test_a_large_table_has_more_ranges(spark, tmp_path, monkeypatch):
    """A table had as many ranges as a shuffle has tasks, so what a task sorted grew with the table."""
    monkeypatch.setattr(postings, "RANGE", 1000)
    rows = spark.range(20_000).selectExpr("CAST(id * 7919 % 20000 AS STRING) AS term", "id AS doc_id")
    table = postings.written(rows, str(tmp_path / "table"), "term", "doc_id").withColumn("file", F.input_file_name())
    files = table.groupBy("file").agg(F.count("*").alias("n"), F.min("term").alias("a"), F.max("term").alias("b")).orderBy("a").collect()
    assert len(files) > 15 and max(f.n for f in files) < 3000 and sum(f.n for f in files) == 20_000
    assert all(one.b < two.a for one, two in zip(files, files[1:], strict=False))


def test_classes_are_not_broadcast(spark):
    """Estimates of derived names are low, so the table of all classes was in the memory of every task."""
    files = spark.range(50).selectExpr("concat('f', id) AS path", "'p' AS package", "concat('C', id) AS class_names")
    imports = spark.range(50).selectExpr("concat('f', id) AS file_path", "explode(array(concat('p.C', id), 'p.C1.Inner', 'q.None')) AS import")
    found = codeintel.resolve_imports(imports, files)
    assert {(r["import"], r.file) for r in found.collect()} == {*[(f"p.C{k}", f"f{k}") for k in range(50)], ("p.C1.Inner", "f1"), ("q.None", None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
