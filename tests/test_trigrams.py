"""Trigram searches find what a full scan finds, and read what they must."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusframe.operators import postings, trigrams

PATTERNS = ["worthless", "(?i)Worth|CLOWN", "wor(th|k)less", "colou?r", "a.*b", "ab+c", "abc{2,3}d", "(abc|abd)e?f", "[ab]cd", "[a-z]bcd", "^start", "end$", "\\bword\\b", "x(?=yz)yzw", "(?!no)yes", "", "ab", ".", "(abc)*def", "(abc)+def", "a|bcd", "über", "stra(ss|ß)e", "(?:one|two) (?:three|four)", "\\Qa.b\\E", "one\\.two", "\\d+ items", "[^a]bcd", "((((deep))))er", "(abcd|abc)", "a{3}", "(?s)abc.def"]


def test_what_patterns_need():
    n = trigrams.needed
    assert n("worth") == [frozenset({"wor", "ort", "rth"})] and n("WORTH") == n("worth")
    assert set(n("wor(th|k)")) == {frozenset({"wor", "ort", "rth"}), frozenset({"wor", "ork"})}
    assert n("abc.*def") == [frozenset({"abc", "def"})] and n("colou?r")[0] <= {"col", "olo", "lor", "lou", "our"}
    assert set(n("cat|dog")) == {frozenset({"cat"}), frozenset({"dog"})}
    for nothing in ("", "ab", ".*", "a|bcd", "(abc)?", "übe", "\\Qabc\\E", "(", "[a-z]{9}", "(?iu)abc", "(?x)a b c"):
        assert n(nothing) == [frozenset()], nothing
    assert n("(abc|abcd)x*") == [frozenset({"abc"})], "the longer asks no less"
    assert trigrams.needed_by_text("aÜbcde") == [frozenset({"bcd", "cde"})]


@settings(max_examples=400, deadline=None)
@given(st.text("abc|()*+?.[]^$", max_size=14), st.text("abc", max_size=12))
def test_a_match_has_what_is_needed(pattern, text):
    try:
        found = re.search(pattern, text)
    except re.error:
        return
    if found:
        own = {text[i : i + 3] for i in range(len(text) - 2)}
        assert any(a <= own for a in trigrams.needed(pattern))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    r = random.Random(6)
    words = "worthless clown abc abcd abcdef bcd acd colour color start end word xyzw yes over Über straße strasse one two three four one.two 12 items deeper AAA abccd abf abdf abcdefx abc\ndef".split(" ")
    texts = [None, "", "ab"] + [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3).cache()
    return df, postings.written(trigrams.postings(df, "id", "text"), str(tmp_path_factory.mktemp("grams")), "gram", "id")


@pytest.mark.parametrize("pattern", PATTERNS)
def test_grep(docs, pattern):
    df, index = docs
    want = {r.id for r in df.where(F.col("text").rlike(pattern)).collect()}
    assert {r.id for r in trigrams.grep(df, index, "id", "text", pattern).collect()} == want


@pytest.mark.parametrize("text", ["worthless", "Clown", "ß", "e s", "", "12 it", "abc\ndef", "one.two", "%_"])
def test_containing(docs, text):
    df, index = docs
    assert {r.id for r in trigrams.containing(df, index, "id", "text", text).collect()} == {r.id for r in df.where(F.col("text").contains(text)).collect()}
    assert {r.id for r in trigrams.containing(df, index, "id", "text", text, any_case=True).collect()} == {r.id for r in df.where(F.lower("text").contains(text.lower())).collect()}


def test_few_rows_are_read(docs):
    """The candidates of a rare word are the rows that have it, or little more; the scan of the index gets the trigrams."""
    df, index = docs
    want = df.where(F.col("text").rlike("deeper|worthless clown")).count()
    keys = trigrams.candidates(index, "id", trigrams.needed("deeper|worthless clown"))
    assert want <= keys.count() < 0.5 * df.count()
    assert "In(gram, [" in keys._jdf.queryExecution().executedPlan().toString()
    assert trigrams.candidates(index, "id", trigrams.needed("a.c")) is None


def test_grams(spark):
    rows = spark.createDataFrame([(1, "ABCabcd"), (2, None), (3, "äöüß"), (4, "ab"), (5, "😀😀😀x")], "id long, text string")
    got = {r.id: set(r.g) for r in rows.select("id", trigrams.grams(F.col("text")).alias("g")).collect()}
    assert got == {1: {"abc", "bca", "cab", "bcd"}, 2: set(), 3: {"äöü", "öüß"}, 4: set(), 5: {"😀😀😀", "😀😀x"}}
    assert trigrams.postings(rows.limit(0), "id", "text").count() == 0
