"""Fill-in-middle and common lines against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusframe.llm import fim, lines

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = ["\x01", "\x02", "\x020\x021", "a\x01b\x02c", "\x01\x01x", "\x02\x01", "1\x020\x0211", "<P", "x<P>y", "<S>", "ab<M>", "<<S", "<P<S<M", "a\r\nb\x00c", "$0 \\1 $1", "日本 語 😀👩‍👩 ß", "A" * 9000 + " " + "\x01" * 500, "-" * 5000]


def fim_rows():
    r = random.Random(5)
    out = [(k, t) for k, t in enumerate(ODD * 6)]
    out += [(1000 + k, "".join(r.choice("ab \n\x01\x02<PSM>é😀01") for _ in range(r.randint(0, 40)))) for k in range(400)]
    return [*out, (None, "no key here"), (5000, None), (5001, ""), (-7, "minus seven " * 3), *[(5002, "twice and again, twice and again")] * 2]


def cut(key, text, seed=1, cut=90, spm=20, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    unit = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = SHA(f"{seed}:{'' if key is None else key}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(unit)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in markers) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    p, m, s = "".join(unit[:a]), "".join(unit[a:b]), "".join(unit[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"{markers[1]}{s}{markers[0]}{p}{markers[2]}{m}"
    return n, "psm", len(p), len(m), f"{markers[0]}{p}{markers[1]}{s}{markers[2]}{m}"


@pytest.mark.parametrize("more", [{}, {"seed": 9, "cut": 100, "spm": 60, "markers": ("[[a]]", "[[b]]", "[[c]]")}])
def test_fill_in_middle(spark, more):
    rows = fim_rows()
    found = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more)
    back = fim.restored(F.col("output"), F.col("form"), *([more["markers"]] if more else []))
    got = found.withColumn("back", back).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((k, t, *cut(k, t, **more)) for k, t in rows)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_long_and_clashing_rows(spark, none):
    long = "word, " * 400_000
    docs = spark.createDataFrame([(3, long, "a", "b", 1)], "doc_id long, text string, n string, __text string, form long")
    r = fim.fill_in_middle(docs).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(3, long) and r["__text"] == "b" and r.form != 1
    assert fim.fill_in_middle(none).count() == 0
    assert fim.fill_in_middle(docs.toDF("doc_id", "p", "text", "output", "m"), text="p", key="doc_id").columns == ["doc_id", "p", "text", "m", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_fill_in_middle_moves_no_row_and_needs_no_worker(spark, sf):
    plan = fim.op11_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_op11(spark, sf, docs):
    got = Counter(tuple(r) for r in fim.op11_fill_in_middle(spark, sf).collect())
    want = Counter()
    for r in docs.collect():
        *head, output = cut(r.doc_id, r.text)
        want[(r.doc_id, *head, SHA(output), SHA(r.text or ""))] += 1
    assert got == want


def line_rows():
    shared = "a line that many documents share"
    r = random.Random(8)
    pool = [f"common line number {k} of the pool, long enough" for k in range(12)] + ["short", "", "  ", "nineteen characters", "twenty characters ok", "ZWÖLF große Bücher im Regal", "zwölf große bücher im regal"]
    out = [(k, "\n".join(r.choice(pool) if r.random() < 0.4 else f"only in {k} at {r.random()}" for _ in range(r.randint(1, 12)))) for k in range(60)]
    out += [(100, shared), (101, f"  {shared.upper()}\t"), (102, f"x\n{shared}\r\n{shared}\x0b\ny"), (103, "two of them hold this line only"), (104, "two of them hold this line only")]
    out += [(105, "one document thrice, in rows of its own"), (105, "one document thrice, in rows of its own\nx"), (105, "one document thrice, in rows of its own\ny")]
    out += [(None, shared), (None, "without a key this is no document"), (None, "without a key this is no document\n"), (1, "without a key this is no document"), (2, "without a key this is no document")]
    out += [(200, None), (201, ""), (202, "\n\n"), (203, " a line that many documents share"), *[(204, f"twice\n{shared}")] * 2]
    out += [(300, "\n".join([shared] * 3000 + ["the end of it"])), (301, "\n".join(f"{k} of a long document, line by line" for k in range(20_000))), (302, "\n".join(f"{k} of a long document, line by line" for k in range(0, 20_000, 2))), (303, "\n".join(f"{k} of a long document, line by line" for k in range(0, 20_000, 3)))]
    return out


def without_common(rows, least=3, chars=20):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    holds = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars and doc is not None:
                holds[key(line)].add(doc)
    last = {k: max(d) for k, d in holds.items() if len(d) >= least}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in last or last[key(x)] == doc]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("more", [{}, {"least": 2, "chars": 5}])
def test_common_lines(spark, more):
    rows = line_rows()
    got = lines.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **more).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == Counter(without_common(rows, **more))
    assert sum(r.text is None for r in got) == 1


def test_common_lines_of_clashing_columns_and_no_rows(spark, none):
    rows = line_rows()
    clash = spark.createDataFrame([(t, k, "kept", 5, 6) for k, t in rows], "h1 string, doc long, row string, n_lines long, gone long")
    found = lines.drop_common_lines(clash, text="h1", key="doc")
    assert found.columns == ["h1", "doc", "row", "gone", "n_lines", "n_dropped"]
    assert Counter((r.doc, r.n_lines, r.n_dropped, r.h1 or "") for r in found.collect()) == Counter(without_common(rows))
    assert lines.drop_common_lines(none).count() == 0


def test_common_lines_are_native(spark, sf):
    df = lines.op12_line_dedup(spark, sf)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    keys = lines.common_keys(rows)
    plan = lines.dropped_positions(rows.withColumn("row", F.xxhash64("text")), keys)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_op12(spark, sf, docs):
    got = Counter(tuple(r) for r in lines.op12_line_dedup(spark, sf).collect())
    assert got == Counter((d, n, k, SHA(t)) for d, n, k, t in without_common([(r.doc_id, r.text) for r in docs.collect()]))
