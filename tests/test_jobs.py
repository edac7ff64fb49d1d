"""The jobs: growing input, runs that fail half-way, reruns, odd rows, and the rows that SQL gives."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusframe.operators.windows import line_windows
from jobs import chunk_index, common, registry, term_index

from .test_queries import FOLDER, duck, plain  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, rows, folder):
    """Adds a file to a folder, as a feed does."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def row(k, text, lang="en"):
    return k, text, lang, "src1", 0 if text is None else len(text)


def chunks_of(rows):
    """What the index of the newest texts must be."""
    out = Counter()
    for k, (text, lang) in rows.items():
        own = (text or "").split("\n")
        for part, (s, e) in enumerate(line_windows([len(x) for x in own])):
            content = "\n".join(own[s:e])
            out[(k, part, s + 1, e, len(content) // 4, content, lang)] += 1
    return out


def indexed(spark, output):
    return Counter((r.doc_id, r.part, r.line_start, r.line_end, r.token_count, r.content, r.lang) for r in chunk_index.current(spark, output).collect())


LONG = "\n".join(f"line {k} of a text that takes several windows" for k in range(400))


def test_chunk_index_takes_only_what_is_new(spark, tmp_path):
    docs, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    put(spark, [row(1, LONG), row(2, "two", "de"), row(3, None, None), row(4, ""), row(None, "no key"), row(-5, "minus")], docs)
    first = chunk_index.run(spark, docs, out, mark)
    want = {1: (LONG, "en"), 2: ("two", "de"), 3: (None, None), 4: ("", "en"), -5: ("minus", "en")}
    assert first["rows"] == 6 and first["without_key"] == 1 and first["documents"] == 5 and first["batches"] == 1
    assert indexed(spark, out) == chunks_of(want) and first["chunks"] == sum(chunks_of(want).values())
    assert chunk_index.run(spark, docs, out, mark) == {} and indexed(spark, out) == chunks_of(want)

    put(spark, [row(2, "two again, " + LONG, "fr"), row(6, "six"), row(6, "six"), row(1, "short now")], docs)
    second = chunk_index.run(spark, docs, out, mark)
    want |= {2: ("two again, " + LONG, "fr"), 6: ("six", "en"), 1: ("short now", "en")}
    assert second["rows"] == 4 and second["documents"] == 3 and second["batches"] == 1
    assert indexed(spark, out) == chunks_of(want)
    assert chunk_index.run(spark, docs, out, mark) == {} and indexed(spark, out) == chunks_of(want)


def test_chunk_index_after_a_failure(spark, tmp_path, monkeypatch):
    """A run that breaks after it has written is done again, and leaves each row once."""
    docs, out, mark = (f"{tmp_path}/{n}" for n in ("docs", "out", "mark"))
    put(spark, [row(k, f"text {k}\n" * k) for k in range(30)], docs)
    put(spark, [row(k, f"newer text {k}") for k in range(10, 40)], docs)
    whole = chunk_index.index_batch

    def broken(output, done):
        run = whole(output, done)

        def go(batch, number):
            run(batch, number)
            raise RuntimeError("lost")

        return go

    monkeypatch.setattr(chunk_index, "index_batch", broken)
    with pytest.raises(Exception, match="lost"):
        chunk_index.run(spark, docs, out, mark, {"max_files": 1})
    monkeypatch.undo()
    done = chunk_index.run(spark, docs, out, mark, {"max_files": 1})
    assert done["batches"] == 2 and done["rows"] == 60
    rows = {k: (f"text {k}\n" * k, "en") for k in range(30)} | {k: (f"newer text {k}", "en") for k in range(10, 40)}
    assert indexed(spark, out) == chunks_of(rows)
    assert spark.read.parquet(out).select("batch").distinct().count() == 2


def test_chunk_index_of_a_glob_and_of_nothing(spark, tmp_path):
    docs = f"{tmp_path}/in/a.parquet"
    put(spark, [row(1, "one")], docs)
    assert chunk_index.run(spark, f"{tmp_path}/in/*.parquet", f"{tmp_path}/o", f"{tmp_path}/m")["documents"] == 1
    put(spark, [], f"{tmp_path}/none")
    chunk_index.run(spark, f"{tmp_path}/none", f"{tmp_path}/p", f"{tmp_path}/n")
    assert chunk_index.current(spark, f"{tmp_path}/p").count() == 0


def test_languages_are_pruned_and_reads_are_of_keys_alone(spark, tmp_path):
    put(spark, [row(1, "one"), row(2, "zwei", "de")], f"{tmp_path}/docs")
    chunk_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/o", f"{tmp_path}/m")
    plan = chunk_index.current(spark, f"{tmp_path}/o").where("lang = 'de'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan and "ReadSchema: struct<doc_id:bigint,part:int>" in plan


def test_term_index(spark, tmp_path):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    rows = [row(1, "One two two"), row(2, "two ÜBER über", "de"), row(3, None), row(4, "...", None), row(None, "two"), row(5, "same"), row(5, "same")]
    put(spark, rows, docs)
    done = term_index.run(spark, docs, out)
    assert done == {"documents": 7, "words": 9, "postings": 7, "terms": 5}
    before = [Counter(t.collect()) for t in term_index.tables(spark, out)]
    assert {(r.lang, r.term): (r.documents, r.occurrences) for r in before[2]} == {("en", "one"): (1, 1), ("en", "two"): (2, 3), ("de", "two"): (1, 1), ("de", "über"): (1, 2), ("en", "same"): (2, 2)}
    assert Counter((r.doc_id, r.dl) for r in before[1].elements()) == Counter([(1, 3), (2, 3), (3, 0), (4, 0), (None, 1), (5, 1), (5, 1)])
    assert term_index.run(spark, docs, out) == done
    assert [Counter(t.collect()) for t in term_index.tables(spark, out)] == before
    put(spark, [row(9, "neu", "fr")], docs)
    term_index.run(spark, docs, out)
    assert {r.lang for r in term_index.tables(spark, out)[0].select("lang").collect()} == {"en", "de", "fr"}


def test_a_common_term_fills_several_tasks_and_files_are_sorted(spark, tmp_path):
    put(spark, [row(k, f"the word {k}") for k in range(4000)], f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        term_index.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = spark.read.parquet(f"{tmp_path}/out/postings").select("term", "doc_id", F.input_file_name().alias("file"))
    assert files.where("term = 'the'").select("file").distinct().count() >= 2
    assert files.groupBy("file").count().agg(F.max("count")).first()[0] < 2 * 12_000 / 4
    for name in (r.file for r in files.select("file").distinct().collect()):
        own = [(r.term, r.doc_id) for r in spark.read.parquet(name).coalesce(1).select("term", "doc_id").collect()]
        assert own == sorted(own)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    df = registry.QUERIES[name](spark, FOLDER)
    assert {k: spark.conf.get(k) for k in before} == before
    columns = sorted(df.columns)
    r = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    assert sorted(tuple(plain(x[c]) for c in columns) for x in df.collect()) == sorted(tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall())


def test_jobs_know_nothing_of_llm():
    code = "import sys; import jobs.registry; print([m for m in sys.modules if '.llm' in m or m == 'corpus_pipeline'])"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert done.stdout.strip().endswith("[]")


def test_config(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"max_files": 7}))
    assert common.config("chunk_index", str(tmp_path / "own.json"))["max_files"] == 7
    assert common.config("chunk_index")["max_files"] == 1000
    with pytest.raises(SystemExit):
        common.command("term_index", "text", ["documents"], None, [])


def test_command_line(spark, tmp_path):
    """A job as a user starts it: a session of its own, the second run finds nothing new."""
    put(spark, [row(1, "one\ntwo")], f"{tmp_path}/docs")
    given = ["-m", "jobs.chunk_index", "--documents", f"{tmp_path}/docs", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[1] --driver-memory 1g --conf spark.ui.enabled=false pyspark-shell"}
    said = [subprocess.run([sys.executable, *given], capture_output=True, text=True, timeout=300, check=True, env=env).stderr for _ in range(2)]
    assert "read 1 rows (0 without doc_id), wrote 1 chunks of 1 documents" in said[0] and "nothing new" in said[1]
    assert duckdb.sql(f"SELECT doc_id, content FROM read_parquet('{tmp_path}/out/*/*/*.parquet')").fetchall() == [(1, "one\ntwo")]
