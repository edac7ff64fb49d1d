"""The pieces that SQL does not check: catalog, state, git, streams, tools, arguments."""

from __future__ import annotations

import json
import os
import random
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusframe.functions import paths
from corpusframe.functions import text as txt
from corpusframe.operators import codeintel, embeddings, history, incremental, ranking, scoring
from corpusframe.operators.filters import Term
from corpusframe.plans import render
from corpusframe.plans import validation as v
from corpusframe.plans.api import Engine
from corpusframe.sources import files, git, state
from corpusframe.sources.catalog import Catalog, Conflict
from corpusframe.streaming import index

TREE = {
    "app/src/main/java/zoo/Dog.java": "package zoo;\nimport zoo.food.Food;\npublic class Dog implements Animal {\n  Food food;\n  void bark() { food.eat(); }\n}\n",
    "app/src/main/java/zoo/food/Food.java": "package zoo.food;\npublic class Food {\n  void eat() {}\n}\n",
    "app/src/test/java/zoo/DogTest.java": "package zoo;\nimport zoo.Dog;\nclass DogTest {\n  Dog dog;\n  void bark() { dog.bark(); }\n}\n",
    "web/main.ts": "import {x} from './x';\nexport class Kennel { open(): void { return; } }\n",
    "build/out.java": "class Skipped {}\n",
    "README.md": "A kennel for dogs. " * 30 + "\n",
}


def write(root, tree):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    write(root, TREE)
    (root / "picture.java").write_bytes(b"\xff\xd8\x00\x00class X {}")
    (root / "latin.py").write_bytes(b"x = '\xe9'\n")
    from corpusframe.operators.languages import all_suffixes

    sources = files.sources(spark, str(root), suffixes=all_suffixes())
    e = Engine(spark, Catalog(spark, str(tmp_path_factory.mktemp("catalog")), "zoo"))
    e.sources, e.root = sources, root
    e.changes_made = {r.path: r.status for r in e.reindex(sources).collect()}
    return e


def test_full_then_incremental(engine, spark):
    assert set(engine.changes_made.values()) == {"A"} and "build/out.java" not in engine.changes_made and "picture.java" not in engine.changes_made
    assert engine.reindex(engine.sources).count() == 0
    status = {r.collection: r.doc_count for r in engine.index_status().collect()}
    assert status["files"] == len(engine.changes_made) == 6 and status["symbols"] > 8


def test_changes_replace_and_remove_rows(spark, tmp_path):
    write(tmp_path / "r", {"a.py": "def one(): pass\n", "b.py": "def two(): pass\n"})
    e = Engine(spark, Catalog(spark, str(tmp_path / "c")))
    e.reindex(files.sources(spark, str(tmp_path / "r")))
    (tmp_path / "r/a.py").write_text("def uno(): pass\n")
    (tmp_path / "r/b.py").unlink()
    (tmp_path / "r/c.py").write_text("def three(): pass\n")
    spark.catalog.refreshByPath(str(tmp_path / "r"))
    got = {r.path: r.status for r in e.reindex(files.sources(spark, str(tmp_path / "r"))).collect()}
    assert got == {"a.py": "M", "b.py": "D", "c.py": "A"}
    assert {r.name for r in e.catalog.open("symbols").collect()} == {"uno", "three"}
    assert {r.path for r in e.catalog.open("files").collect()} == {"a.py", "c.py"}


def test_a_folder_is_read_where_it_may_have_changed(spark, tmp_path):
    """A file whose moment and size are as they were isn't opened; one that is touched but the same is read and no change."""
    root = tmp_path / "r"
    write(root, {"a.py": "def one(): pass\n", "b.py": "def two(): pass\n", "sub/c.py": "def three(): pass\n", "d.py": "def four(): pass\n"})
    (root / "bin.py").write_bytes(b"\x00\x01")
    e = Engine(spark, Catalog(spark, str(tmp_path / "c")))
    go = lambda **more: {r.path: r.status for r in (spark.catalog.refreshByPath(str(root)), e.reindex_folder(str(root), **more))[1].collect()}
    looked = lambda: {r.path for r in e.catalog.open("marks").collect()}
    names = lambda: {r.name for r in e.catalog.open("symbols").collect()}
    assert go() == dict.fromkeys(["a.py", "b.py", "sub/c.py", "d.py"], "A") and looked() == {"a.py", "b.py", "sub/c.py", "d.py", "bin.py"}
    assert go() == {} and looked() == set()
    was = (root / "a.py").stat()
    (root / "a.py").write_text("def eno(): pass\n")  # of the same size
    os.utime(root / "a.py", ns=(was.st_atime_ns, was.st_mtime_ns))
    os.utime(root / "b.py", (1, 1))
    (root / "sub/c.py").write_text("def changed(): pass\n")
    (root / "d.py").unlink()
    write(root, {"new/e.py": "def five(): pass\n"})
    assert go() == {"sub/c.py": "M", "d.py": "D", "new/e.py": "A"} and looked() == {"b.py", "sub/c.py", "new/e.py"}
    assert names() == {"one", "two", "changed", "five"}, "a.py was not opened"
    assert go() == {} and looked() == set()
    (root / "bin.py").write_text("def text(): pass\n")
    (root / "b.py").write_bytes(b"\x00 no text any more")
    assert go() == {"bin.py": "A", "b.py": "D"} and names() == {"one", "changed", "five", "text"}
    assert go(mode="full")["a.py"] == "A" and names() == {"eno", "changed", "five", "text"}


def test_a_repository_tells_what_a_listing_does_not(spark, tmp_path):
    """Commits and changes that are in no commit yet, of files whose moment and size are as they were."""
    root = tmp_path / "r"
    write(root, {"a.py": "x = 1\n", "b.py": "y = 1\n", "c.py": "z = 1\n"})
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=A", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    e = Engine(spark, Catalog(spark, str(tmp_path / "c")), folder=str(tmp_path / "state"), repo=str(root))
    go = lambda: {r.path: r.status for r in (spark.catalog.refreshByPath(str(root)), e.reindex_folder(str(root)))[1].collect()}
    assert len(go()) == 3
    for name, text in (("a.py", "x = 2\n"), ("b.py", "y = 2\n")):
        was = (root / name).stat()
        (root / name).write_text(text)
        os.utime(root / name, ns=(was.st_atime_ns, was.st_mtime_ns + 2))  # the listing has milliseconds
        if name == "a.py":
            run("commit", "-qam", "two")
    assert go() == {"a.py": "M", "b.py": "M"} and {r.path for r in e.catalog.open("marks").collect()} == {"a.py", "b.py"}
    assert e.trigger(str(root)).count() == 0


def test_search(engine):
    best, facets = engine.search_symbols("Dog", kinds=("class",))
    rows = best.collect()
    assert rows[0]["name"] == "Dog" and {r.kind for r in rows} == {"class"}
    assert any(r.facet == "kind" and r.value == "class" for r in facets.collect())
    assert {r["name"] for r in engine.search_symbols("Dog", strict=True, extends_or_implements="Animal")[0].collect()} == {"Dog"}
    code = engine.search_code("bark")
    assert code.count() and not code.where(paths.is_test(F.col("file_path"))).count()
    assert engine.search_code("bark", exclude_tests=False).where(paths.is_test(F.col("file_path"))).count()
    assert engine.search_code("kennel", file_types=("ts",)).select("language").distinct().collect()[0][0] == "typescript"
    assert engine.search_files("Food").first()["filename"] == "Food.java"
    assert {r.extension for r in engine.search_files("Dog", extension=".java").collect()} == {"java"} and not engine.search_files("Dog", extension="py").count()
    assert {r.module for r in engine.search_files("Food Kennel", module="app").collect()} == {"app"}
    assert {r.file_path for r in engine.search_symbols("Dog", file_pattern="**/test/**/*.java")[0].collect()} == {"app/src/test/java/zoo/DogTest.java"}
    assert {r.file_path for r in engine.search_symbols("Dog", file_pattern="zoo/Dog.java")[0].collect()} == {"app/src/main/java/zoo/Dog.java"}
    assert {r.visibility for r in engine.search_symbols("Dog", visibility=("public", "protected"))[0].collect()} == {"public"}
    assert {r.enclosing_class for r in engine.search_code("bark", enclosing_class="Dog").collect()} == {"Dog"}
    assert "Dog" in {r.text for r in engine.autocomplete("do").collect()}
    assert "Dog" in {r.text for r in engine.autocomplete("dug", fuzzy=True).collect()}
    shown = render.hits(best, "Dog")
    assert shown.startswith("Found") and "zoo.Dog" in shown and json.loads(render.hits(best, as_json=True))["results"]
    assert "kind: class" in render.facets(facets)
    assert "> " in render.context(engine.get_context(engine.sources, "README.md", 1, 1), "README.md", 1, 1)


def test_the_term_index_scores_as_the_texts_do(engine):
    from corpusframe.operators import postings
    from corpusframe.schemas import TABLES, fields_with

    for name, query in (("symbols", "Dog bark"), ("chunks", "food eat zoo"), ("files", "food java none")):
        fields = fields_with(TABLES[name], "searchable")
        want = {r.id: round(r.score, 9) for r in scoring.bm25(engine.catalog.open(name), query, fields).collect()}
        index, sizes = engine.catalog.open(f"{name}_terms"), engine.catalog.open(f"{name}_lengths")
        assert want and {r.id: round(r.score, 9) for r in postings.bm25(index, sizes, query, "id", fields).collect()} == want
    plan = postings.bm25(index, sizes, "food", "id", fields)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [food])" in plan or "EqualTo(term,food)" in plan


def test_only_touched_buckets_are_written(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([(f"f{i % 50}", i) for i in range(500)], "path string, n int")
    c.write_buckets("t", rows, "path", ["n"])
    before = c._pointer("t")["buckets"]
    fresh = spark.createDataFrame([("f1", -1), ("new", -2)], "path string, n int")
    c.replace("t", fresh, spark.createDataFrame([("f1",), ("f2",), ("new",)], "path string"), "path")
    got = {(r.path, r.n) for r in c.open("t").collect()}
    assert got == {(f"f{i % 50}", i) for i in range(500) if i % 50 not in (1, 2)} | {("f1", -1), ("new", -2)}
    after = c._pointer("t")["buckets"]
    assert 0 < sum(before.get(b) != v for b, v in after.items()) <= 3
    c.replace("t", fresh.limit(0), fresh.limit(0), "path")
    assert c._pointer("t")["buckets"] == after
    stale = c._pointer("t")
    c.replace("t", fresh, fresh, "path")
    with pytest.raises(Conflict):
        c._switch("t", stale, stale)


def test_runs_keep_apart_and_know_when_to_start_anew(spark, tmp_path):
    root = tmp_path / "r"
    write(root, {"a.py": "def one(): pass\n", "b.py": "def broken(:\n"})
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=A", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    e = Engine(spark, Catalog(spark, str(tmp_path / "c")), folder=str(tmp_path / "state"), repo=str(root))
    sources = files.sources(spark, str(root))
    assert e.reindex(sources).count() == 2
    s = state.IndexState.load(e.state_path)
    assert s.last_commit == git.head(str(root)) and s.last_branch and (s.total_files, s.parse_failures) == (2, ["b.py"]) and s.total_symbols == 1
    assert e.reindex(sources).count() == 0
    s.last_commit = "0" * 40  # a commit that a rewritten history has lost
    s.save(e.state_path)
    assert e.reindex(sources).count() == 2 and state.IndexState.load(e.state_path).last_commit == git.head(str(root))
    with state.lock(tmp_path / "state/index.lock"):
        assert e.trigger(sources) is None
        with pytest.raises(state.Locked):
            e.reindex(sources)
    e.reindex(sources, encoder=embeddings.hashing_encoder)  # vectors that the index lacks: a full run
    vector = [float(x) for x in embeddings.hashing_encoder()(["def one(): pass"])[0]]
    assert "embedding" in e.catalog.open("chunks").columns and e.search_code("one", vector=vector).first()["file_path"] == "a.py"


def test_unwanted_files_are_not_read(spark, tmp_path):
    write(tmp_path, {"src/a b[1].py": "x = 1\n", "node_modules/c.js": "1", "lib.jar": "2", "d.md": "text\n"})
    found = files.sources(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"src/a b[1].py", "d.md"}
    assert {p.rsplit("/", 1)[1] for p in found.inputFiles()} == {"a%20b%5B1%5D.py", "d.md"}
    assert files.sources(spark, str(tmp_path), suffixes=[".none"]).count() == 0


def test_code_intelligence(engine):
    assert [r.qualified_name for r in engine.find_implementations("animal").collect()] == ["zoo.Dog"]
    assert "zoo.DogTest" in {r.qualified_name for r in engine.find_references("Dog").collect()}
    forward, backward, further = engine.dependency_graph("Food.java", depth=2)
    assert {r.file for r in backward.collect()} == {"app/src/main/java/zoo/Dog.java"}
    assert {r.node for r in further.where("level = 2").collect()} == {"app/src/test/java/zoo/DogTest.java"}
    forward, backward, _ = engine.dependency_graph("app/src/main/java/zoo/Dog.java")
    assert [(r["import"], r.file) for r in forward.collect()] == [("zoo.food.Food", "app/src/main/java/zoo/food/Food.java")]
    assert render.graph("x", ["Dog"], forward, backward)["depended_by_count"] == 1
    with pytest.raises(ValueError):
        codeintel.transitive(None, None, depth=4)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), "n")
    c.write("t", spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, n int"))
    assert c.upsert("t", spark.createDataFrame([("b", 3), ("d", 4)], "id string, n int")) == 4
    assert {(r.id, r.n) for r in c.open("t").collect()} == {("a", 1), ("b", 3), ("c", None), ("d", 4)}
    assert c.delete("t", [Term("n", 3)]) == 3 and c.count("t", [Term("n", 1)]) == 1
    assert [r.id for r in c.lookup("t", ["a", "zz"]).collect()] == ["a"]
    assert c.force_merge("t", 1)[1] == 1 and c.list() == ["t"] and c.missing(["t", "u"]) == ["u"]
    from pyspark.sql import types as T

    c.update_schema("t", T.StructType().add("id", "string").add("n", "long").add("x", "string"))
    assert c.open("t").columns == ["id", "n", "x"] and c.count("t") == 3
    with pytest.raises(KeyError):
        c.open("nothing")


@pytest.mark.parametrize("broken", ["", "{", "[1]", '{"last_commit": 3}', "\x00\xff"])
def test_broken_state_is_empty(tmp_path, broken):
    (tmp_path / "s.json").write_text(broken)
    assert state.IndexState.load(tmp_path / "s.json") == state.IndexState()


def test_state_and_lock(tmp_path):
    s = state.IndexState("abc", "main", "2024-01-01", True)
    s.save(tmp_path / "d/s.json")
    assert state.IndexState.load(tmp_path / "d/s.json") == s
    with state.lock(tmp_path / "l"):
        with pytest.raises(state.Locked), state.lock(tmp_path / "l"):
            pass
    (tmp_path / "l").write_text("999999999")
    with state.lock(tmp_path / "l"):
        pass


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("git")

    def run(*a, date="2024-01-01T00:00:00"):
        subprocess.run(["git", "-C", root, "-c", "user.name=Ann | Lee", "-c", "user.email=ann@example.com", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "GIT_COMMITTER_DATE": date, "GIT_AUTHOR_DATE": date, "HOME": str(root)})

    run("init", "-q")
    (root / "a.txt").write_text("one\ntwo\nthree\n")
    run("add", ".")
    run("commit", "-qm", "first: add | a", date="2024-01-01T00:00:00")
    (root / "a.txt").write_text("one\n2\nthree\n")
    run("commit", "-qam", "second\n\nwith a\nbody", date="2024-01-02T00:00:00")
    run("mv", "a.txt", "b.txt")
    run("commit", "-qm", "rename", date="2024-01-03T00:00:00")
    return str(root)


def test_git_source(spark, repo, tmp_path):
    git.register(spark)
    load = lambda t: spark.read.format("gitlog").option("repo", repo).option("table", t).load()
    commits, changes, versions = load("commits").cache(), load("changes").cache(), load("versions").cache()
    rows = {r.subject: r for r in commits.collect()}
    assert rows["first: add | a"].author_name == "Ann | Lee" and rows["second"].body == "with a\nbody"
    assert [r.path for r in load("files").collect()] == ["b.txt"]
    assert {(r.path, r.old_path, r.status) for r in changes.collect()} == {("a.txt", None, "A"), ("a.txt", None, "M"), ("b.txt", "a.txt", "R")}
    e = Engine(spark, Catalog(spark, str(tmp_path)), commits, changes, versions)
    assert [r.subject for r in e.search_commits(query="FIRST|second").collect()] == ["second", "first: add | a"]
    assert [r.subject for r in e.search_commits(as_of=datetime(2024, 1, 4), since="2 days ago", author="ann").collect()] == ["rename", "second"]
    assert [r.subject for r in e.search_commits(file_path="b.txt").collect()] == ["rename"]
    diff = e.commit_diff(rows["second"].sha[:8]).first()
    assert diff.files_changed == 1 and "-two\n+2" in diff.files[0]["diff"]
    assert [(r.subject, r.previous_sha) for r in e.file_history("b.txt").collect()] == [("rename", rows["second"].sha), ("second", rows["first: add | a"].sha), ("first: add | a", None)]
    assert e.file_history("b.txt", follow=False).count() == 1
    with pytest.raises(git.GitError):
        git.git(repo, "no-such-command")
    with pytest.raises(git.GitError):
        git.git(repo + "/none", "log")
    assert "rename" in render.commits(commits)
    shown = {r.subject: r["diff"] for r in e.file_history("b.txt", include_diff=True).collect()}
    assert "-two\n+2" in shown["second"] and "+++ b/a.txt" in shown["first: add | a"] and "--- /dev/null" in shown["first: add | a"]
    assert git.exists(repo, rows["second"].sha) and not git.exists(repo, "0" * 40) and git.head(repo) == rows["rename"].sha and git.branch(repo)
    assert {(r.path, r.status) for r in incremental.as_changes(changes.where("status = 'R'")).collect()} == {("a.txt", "D"), ("b.txt", "M")}


def test_dates():
    now = datetime(2024, 3, 10)
    assert history.moment("7 days ago", now) == datetime(2024, 3, 3) and history.moment("a week ago", now) == datetime(2024, 3, 3)
    assert history.moment("2024-01-05", now) == datetime(2024, 1, 5) and history.moment("yesterday", now) == datetime(2024, 3, 9)
    with pytest.raises(ValueError):
        history.moment("soon", now)


def test_stream(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    make = lambda rows: spark.createDataFrame(rows, index.SOURCE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make([("a.py", "def one(): pass\n", 1, "UPDATE"), ("b.py", "def two(): pass\n", 1, "UPDATE"), ("a.py", "def uno(): pass\n", 2, "UPDATE")])
    go = lambda: index.keep_indexed(spark, str(tmp_path / "in"), c, str(tmp_path / "ck"), lock_path=str(tmp_path / "lock")).awaitTermination()
    names = lambda: {r.name for r in c.open("symbols").collect()}
    before = spark.conf.get(index.STATE_STORE)
    go()
    assert names() == {"uno", "two"} and spark.conf.get(index.STATE_STORE) == before
    make([("b.py", "", 3, "DELETE"), ("c.py", "def three(): pass\n", 3, "UPDATE")])
    go()
    assert names() == {"uno", "three"}
    make([("a.py", "def late(): pass\n", 1, "UPDATE"), ("b.py", "def gone(): pass\n", 2, "UPDATE"), ("c.py", "", 2, "DELETE"), ("c.py", "def three(): pass\n", 3, "UPDATE")])
    go()
    assert names() == {"uno", "three"}, "what comes late changes nothing"
    make([("b.py", "def back(): pass\n", 9, "UPDATE")])
    go()
    assert names() == {"uno", "three", "back"}
    assert {r.path for r in c.open("files").collect()} == {"a.py", "b.py", "c.py"}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_feed_in_any_order(spark, tmp_path, seed):
    """Shuffled, repeated and cut into batches, a feed gives the rows that it gives at once."""
    r = random.Random(seed)
    feed = [(r.randint(0, 8), seq, r.choice(["UPDATE", "UPDATE", "DELETE"]), f"v{seq}") for seq in range(60)]
    schema = "id long, seq long, action string, v string"
    sent = [*feed, *r.sample(feed, 20)]
    r.shuffle(sent)
    c = Catalog(spark, str(tmp_path / "c"))
    for k in range(0, len(sent), 20):
        spark.createDataFrame(sent[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = index.change_stream(spark, str(tmp_path / "in"), schema)
        index.keep_current(stream, c, "items", "id", "seq", str(tmp_path / "ck")).awaitTermination()
    want = {}
    for k, seq, action, text in feed:
        want[k] = None if action == "DELETE" else (seq, text)
    assert {x.id: (x.seq, x.v) for x in c.open("items").collect()} == {k: x for k, x in want.items() if x}


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.kind, r.n) for r in index.windowed_counts(rows, "ts", "kind").collect()} == {("a", 2), ("b", 1)}


@pytest.mark.parametrize("path", ["", "../x", "/etc/passwd", "a/../../b", "C:\\x", "a\x00b", "~/x", "..\\x"])
def test_paths_that_leave(path):
    with pytest.raises(ValueError):
        v.relative(path)


def test_arguments():
    assert v.relative("a/b..c.py") and v.sha("ABCD12") == "abcd12" and v.limit(100) == 100
    for bad in (0, 101, True, "3"):
        with pytest.raises(ValueError):
            v.limit(bad)
    for bad in ("", "xyz1", "abc", "g" * 8):
        with pytest.raises(ValueError):
            v.sha(bad)
    with pytest.raises(ValueError):
        v.query("x" * 501)
    with pytest.raises(ValueError):
        v.Context("a.py", 5, 3)
    with pytest.raises(ValueError):
        v.SymbolSearch("x", kinds=("nothing",))
    with pytest.raises(ValueError):
        v.DependencyGraph("")
    assert v.CommitSearch(since="x", until="y", file_path="a", limit=3).limit == 3


@pytest.mark.parametrize("text", ["", "a" * 15_000, "a" * 15_001, "\n" * 20_000, "é" * 16_000, ("x" * 99 + "\n") * 200])
def test_truncation(spark, text):
    shown = render.truncated(text)
    assert (shown == text) == (len(text) <= 15_000) and len(shown) < 15_100
    assert spark.createDataFrame([(text,)], "t string").select(txt.truncated(F.col("t"))).first()[0] == shown


def test_snippets():
    text = "aaa " * 40 + "Needle here " + "bbb " * 40 + "needle again " + "ccc " * 60
    got = ranking.snippets_of(text, ["needle"])
    assert len(got) == 2 and all("**" in s and s.startswith("...") for s in got)
    assert ranking.snippets_of("x" * 400, ["needle"]) == ["x" * 300] and ranking.snippets_of("", []) == [""]
    assert got[0].replace("**", "").strip(".") in text


def test_snippets_in_a_plan(spark):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice(["needle ", "Needle", "thread.", "x" * 30, "ä\n", " "]) for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", "needle"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(ranking.snippets(F.col("t"), "needle thread").alias("s"))
    assert [x.s for x in found.collect()] == [ranking.snippets_of(t or "", ["needle", "thread"]) for t in texts]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows.select(ranking.snippets(F.col("t"), "the").alias("s")).first().s == [texts[0][:300]]


@pytest.mark.parametrize("bad", ["(a", "a AND", "NOT", "a )", "OR b"])
def test_query_strings_that_are_broken(spark, bad):
    with pytest.raises(ValueError):
        scoring.query_string(bad, "t")


def test_query_strings(spark):
    rows = spark.createDataFrame([(1, "red apple pie", "en"), (2, "green apple", "fr"), (3, None, "en"), (4, "apply red", "en")], "id int, t string, lang string")
    find = lambda q: {r.id for r in rows.where(scoring.query_string(q, "t")).collect()}
    assert find('"apple pie"') == {1} and find("red green") == {1, 2, 4} and find("appl* AND lang:en") == {1, 4}
    assert find("NOT red") == {2, 3} and find("(red OR green) AND NOT pie") == {2, 4} and find("") == {1, 2, 3, 4}


def test_namespace_and_recency(spark):
    rows = spark.createDataFrame([("/x/My-Repo.git",), ("/x/__",), ("Ab",)], "p string")
    assert [r[0] for r in rows.select(paths.namespace(F.col("p"))).collect()] == ["my_repo_git", "default", "ab"]
    days = spark.createDataFrame([("2024-01-05T00:00:00Z",), ("2023-01-05",), ("bad",), (None,)], "d string")
    assert [r[0] for r in days.select(ranking.recent("2024-01-10 00:00:00", 7, F.col("d"))).collect()] == [True, False, False, False]


def test_embeddings(spark):
    rows = spark.createDataFrame([("red apple",), ("red apple",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(embeddings.embedded(F.col("t"))).collect()]
    assert len(got[0]) == 384 and got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-5 and sum(map(abs, got[2])) == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, t string")
    assert scoring.bm25(none, "x", ["t"]).count() == 0 and ranking.facets(none, ["t"]).count() == 0
    assert scoring.hybrid(none.selectExpr("id", "0D AS score"), none.selectExpr("id", "0D AS score"), "id").count() == 0
    assert incremental.snapshot_diff(none, none, "id", ("t",)).count() == 0
