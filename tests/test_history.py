"""History by ancestry: against brute force over random forests, and against git itself on a repository with merges."""

from __future__ import annotations

import os
import random
import subprocess
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusframe.operators import history, lineage
from corpusframe.plans import catalog
from corpusframe.plans.api import Engine
from corpusframe.sources import git
from corpusframe.sources.catalog import Catalog


def forest(seed: int, n: int, branching: float) -> dict[str, str | None]:
    r = random.Random(seed)
    names = [f"{r.getrandbits(32):08x}" for _ in range(n)]
    return {c: None if not k or r.random() < 0.02 else names[r.randrange(k)] if r.random() < branching else names[k - 1] for k, c in enumerate(names)}


def edits(seed: int, parents) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for c in parents:
        for path in r.sample("abcd", r.randint(0, 2)):
            kind = r.random()
            old = r.choice([x for x in "abcde" if x != path])
            out.append((c, path, old if kind < 0.25 else None, "R" if kind < 0.2 else "C" if kind < 0.25 else "D" if kind < 0.35 else "M"))
    return out


def found_by(parents, changes):
    """{(sha, path): (sha, name, live) or None}: walks up from each change, and the file that each is of."""
    by = {}
    for sha, path, old, status in changes:
        by.setdefault(sha, []).append((path, old, status))
    before = {}
    for sha, path, old, status in changes:
        at, name = parents[sha], old or path
        while at is not None:
            own = [(p, s != "D") for p, o, s in by.get(at, []) if p == name]
            left = [s for p, o, s in by.get(at, []) if s == "R" and o == name]
            if own or left:
                before[sha, path] = (at, name, own[0][1] if own else False)
                break
            at = parents.get(at)
        else:
            before[sha, path] = None
    status_of = {(s, p): x for s, p, _, x in changes}

    def root(key):
        b = before[key]
        return key if b is None or not b[2] or status_of[key] == "C" else root(b[:2])

    return before, {k: ":".join(root(k)) for k in before}


@pytest.mark.parametrize(("seed", "n", "branching"), [(1, 120, 0.15), (2, 60, 0.9), (3, 90, 0.0)])
def test_by_ancestry(spark, seed, n, branching):
    parents = forest(seed, n, branching)
    changes = edits(seed, parents)
    before, ids = found_by(parents, changes)
    edges = spark.createDataFrame(list(parents.items()), "sha string, parent string")
    table = spark.createDataFrame([*changes, *changes[:5]], "sha string, path string, old_path string, status string").repartition(3)
    places = lineage.held(lineage.placed(edges))
    at = {r.sha: r for r in places.collect()}
    assert len(at) == len(parents) and all(at[c].place == (0 if p is None else at[p].place + 1) for c, p in parents.items())
    tails = Counter((at[c].chain) for c, p in parents.items() if p is None or at[p].chain != at[c].chain)
    assert set(tails.values()) == {1}, "a chain is one path"
    links = lineage.linked(table, places)
    got = {(r.sha, r.path): r.before and (r.before.sha, r.before.path, r.before.live) for r in links.collect()}
    assert got == before
    assert {(r.sha, r.path): r.file_id for r in lineage.identified(links).collect()} == ids
    some = spark.createDataFrame([c[:2] for c in changes[::7]], "sha string, path string")
    assert {(r.sha, r.path): r.before and (r.before.sha, r.before.path, r.before.live) for r in lineage.linked(table, places, some).collect()} == {c[:2]: before[c[:2]] for c in changes[::7]}


def test_by_date_where_no_parents_are_known(spark):
    parents = forest(9, 80, 0.0)
    parents = dict(zip(parents, [None, *parents], strict=False))
    changes = edits(4, parents)
    before, ids = found_by(parents, changes)
    start = datetime(2024, 1, 1)
    commits = spark.createDataFrame([(c, start + timedelta(hours=k)) for k, c in enumerate(parents)], "sha string, date timestamp")
    table = spark.createDataFrame(changes, "sha string, path string, old_path string, status string")
    found = history.files_of(commits, table).collect()
    assert {(r.sha, r.path): r.file_id for r in found} == ids
    assert {(r.sha, r.path): r.before and (r.before.sha, r.before.path, r.before.live) for r in found} == before


def test_a_long_line_of_commits(spark):
    """Estimates of size must not grow with the rounds: they did so by powers, until the driver had no memory left for the number."""
    n = 3000
    edges = spark.range(n).select(F.col("id").cast("string").alias("sha"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    places = lineage.placed(edges)
    assert places.select(F.count("*"), F.max("place"), F.count_distinct("chain")).first()[:] == (n, n - 1, 1)
    changes = edges.select("sha", F.lit("a").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("M").alias("status"))
    found = lineage.identified(lineage.linked(changes, places))
    assert found.select("file_id").distinct().collect() == [("0:a",)]
    for df in (places, found):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200


@pytest.mark.parametrize(("seed", "branching", "followed"), [(5, 0.0, 24), (6, 0.3, 24), (7, 0.3, 1)])
def test_one_file_among_the_changes_it_can_depend_on(spark, monkeypatch, seed, branching, followed):
    """Each name's file has the same changes among those of `under_names` as among all, also where steps between names are cut short."""
    monkeypatch.setattr(lineage, "FOLLOWED", followed)
    r, parents = random.Random(seed), forest(seed, 90, branching)
    changes = [(c, f"{group}{path}", old and f"{group}{old}", status) for group in "xyz" for c, path, old, status in edits(r.random(), parents)]
    _, ids = found_by(parents, changes)
    places = lineage.held(lineage.placed(spark.createDataFrame(list(parents.items()), "sha string, parent string")))
    table = spark.createDataFrame(changes, "sha string, path string, old_path string, status string")
    place = {c.sha: c.place for c in places.collect()}
    for path in ("xa", "yc", "none"):
        near = lineage.under_names(table, path)
        assert near.count() == (len(changes) if followed == 1 and path != "none" else sum(p[0] == path[0] for _, p, *_ in changes) if path != "none" else 0)
        last = max(((place[s], s) for s, p in ids if p == path), default=None)
        found = history.of_one_file(history.files_of(None, near, places), path)
        assert {(c.sha, c.path) for c in found.collect()} == {k for k in ids if last and ids[k] == ids[last[1], path]}


def test_one_file_is_found_without_all_others(spark, monkeypatch):
    """The versions of all files were linked, moved and written for the history of one."""
    linked, seen = lineage.linked, []
    monkeypatch.setattr(lineage, "linked", lambda changes, *a, **k: (seen.append(changes.count()), linked(changes, *a, **k))[1])
    commits = spark.range(40).selectExpr("CAST(id AS STRING) AS sha", "TIMESTAMP '2024-01-01' + make_dt_interval(CAST(id AS INT)) AS date")
    many = spark.range(40).crossJoin(spark.range(100).toDF("n")).selectExpr("CAST(id AS STRING) AS sha", "concat('f', n) AS path", "CAST(NULL AS STRING) AS old_path", "'M' AS status")
    changes = many.union(spark.createDataFrame([("7", "new", "f3", "R")], many.schema)).where("NOT (path = 'f3' AND CAST(sha AS INT) >= 7)")
    assert [c.sha for c in history.file_history(commits, changes, "new").collect()] == [str(k) for k in range(7, -1, -1)]
    assert seen == [8]


def test_names_of_one_file_are_found_without_all_others(spark, monkeypatch):
    """The query linked the changes of all files to name one."""
    linked, seen, folder = lineage.linked, [], "/root/testdata/sf0.001"
    monkeypatch.setattr(lineage, "linked", lambda changes, *a, **k: (seen.append(changes.count()), linked(changes, *a, **k))[1])
    catalog.QUERIES["rename_chain"](spark, folder)
    assert len(seen) == 1 and 0 < seen[0] < catalog._file_changes(spark, folder).count() / 2


def test_no_history(spark):
    commits = spark.createDataFrame([], "sha string, date timestamp")
    changes = spark.createDataFrame([], "sha string, path string, old_path string, status string")
    parents = spark.createDataFrame([], "sha string, parent string")
    assert history.file_history(commits, changes, "a").count() == 0
    assert history.files_of(commits, changes, lineage.placed(parents)).count() == 0


class Repository:
    """A repository whose commits all have the date that they are given."""

    def __init__(self, root):
        self.root = root
        self("init", "-q", "-b", "main")

    def __call__(self, *a, date="2024-01-01T00:00:00", ok=True):
        env = {"PATH": os.environ["PATH"], "GIT_COMMITTER_DATE": date, "GIT_AUTHOR_DATE": date, "HOME": str(self.root)}
        return subprocess.run(["git", "-C", self.root, "-c", "user.name=Ann", "-c", "user.email=ann@example.com", *a], check=ok, capture_output=True, env=env, text=True).stdout

    def commit(self, subject, date="2024-01-01T00:00:00", remove=(), **files):
        for name in remove:
            self("rm", "-q", name)
        for name, text in files.items():
            (self.root / name).write_text(text)
        self("add", "-A")
        self("commit", "-q", "--allow-empty", "-m", subject, date=date)


LINES = [f"line {k}" for k in range(20)]


def text(*changed: int, by: str = "x") -> str:
    return "".join(f"{x} {by if k in changed else ''}\n" for k, x in enumerate(LINES))


@pytest.fixture(scope="module")
def merged(tmp_path_factory):
    """Side branches, one of three parents, a merge by hand, a name that three files have had, a file made anew, dates that go back."""
    g = Repository(tmp_path_factory.mktemp("merged"))
    g.commit("root", a=text(), b="b\n", z="z\n")
    g.commit("second at the same moment", a=text(1))
    g("checkout", "-qb", "side")
    g.commit("on the side", a=text(1, 18, by="s"), date="2024-01-05T00:00:00")
    g.commit("made on the side", s="made\non\nthe side\n", date="2024-01-04T00:00:00")
    g("checkout", "-qb", "third", "main")
    g.commit("on a third branch", b="third\n")
    g("checkout", "-qb", "fourth", "main")
    g.commit("a file of the fourth", f="fourth\n")
    g("checkout", "-q", "main")
    g.commit("meanwhile", z="zz\n", date="2023-06-01T00:00:00")
    g("merge", "-q", "--no-ff", "-m", "merge of the side", "side")
    g("merge", "-q", "--no-ff", "-m", "merge of two", "third", "fourth")
    g.commit("after the merge", s="made\non\nthe main line\n", f="fourth again\n")
    g("checkout", "-qb", "clash", "main")
    g.commit("theirs", a=text(1, 5, by="theirs"))
    g("checkout", "-q", "main")
    g.commit("ours", a=text(1, 5, by="ours"))
    g("merge", "-q", "--no-ff", "-m", "by hand", "clash", ok=False)
    g.commit("merge by hand", a=text(1, 5, by="both"))
    g("mv", "a", "old")
    g.commit("a is old now")
    g.commit("another a", a="another\nfile\nof this name\n")
    g("mv", "a", "c")
    g.commit("the other a is c now")
    g.commit("b goes", remove=["b"])
    g.commit("b comes anew", b="new\n")
    return g


@pytest.fixture(scope="module")
def engine(spark, merged, tmp_path_factory):
    git.register(spark)
    load = lambda t: spark.read.format("gitlog").option("repo", str(merged.root)).option("table", t).load().cache()
    return Engine(spark, Catalog(spark, str(tmp_path_factory.mktemp("catalog"))), load("commits"), load("changes"), load("blobs"), parents=load("parents"))


def subjects(df):
    return [r.subject for r in df.collect()]


def test_parents_and_chains(spark, engine, merged):
    rows = spark.read.format("gitlog").option("repo", str(merged.root)).option("table", "parents").load().collect()
    want = [line.split() for line in merged("rev-list", "--parents", "HEAD").splitlines()]
    assert Counter((r.sha, r.parent) for r in rows) == Counter((c, p) for c, *up in want for p in up or [None])
    at = {r.sha: r for r in rows if r.ordinal == 0}
    mainline = merged("rev-list", "--first-parent", "HEAD").split()
    assert {at[c].chain for c in mainline} == {0} and sum(r.chain == 0 for r in at.values()) == len(mainline)
    assert all(at[r.parent].place < r.place for r in rows if r.parent)


def test_all_commits_have_their_changes(engine, merged):
    own = {}
    for r in history.own(engine.changes).collect():
        own.setdefault(r.sha, set()).add((r.path, r.status))
    for c in engine.commits.collect():
        said = merged("diff-tree", "--no-commit-id", "-r", "--root", "--name-status", "-M50%", *([] if " " not in merged("rev-list", "--parents", "-1", c.sha).strip().replace(" ", "", 1) else ["-c"]), c.sha)
        assert own.get(c.sha, set()) == {(x.split("\t")[-1], x[0]) for x in said.splitlines()}, c.subject
    assert subjects(engine.search_commits(file_path="s")) == ["made on the side", "after the merge"]


def test_diffs_are_those_of_git(spark, engine, merged):
    versions = spark.read.format("gitlog").option("repo", str(merged.root)).option("table", "versions").load()
    by_name = Engine(spark, engine.catalog, engine.commits, engine.changes, versions, parents=engine.placed)
    for c in engine.commits.collect():
        said = merged("show", "--format=", "-M50%", "--no-color", "--diff-merges=first-parent", c.sha)
        want = {}
        for part in said.split("diff --git ")[1:]:
            body = part[part.index("\n--- ") + 1 :] if "\n--- " in part else ""
            want[part.splitlines()[0].split(" b/")[-1]] = [x for x in body.splitlines() if not x.startswith("@@")]
        for e in (engine, by_name):
            files = e.commit_diff(c.sha[:12]).first().files or []
            assert {f.path: [x for x in f["diff"].splitlines() if not x.startswith("@@")] for f in files} == {f.path: want[f.path] for f in files}, c.subject
            assert len(files) == len(want) or " of " in c.subject, c.subject


def test_file_histories(engine, merged):
    says = lambda path: merged("log", "--format=%s", "--follow", "--", path).splitlines()
    assert Counter(says("old")) == Counter(["a is old now", "ours", "theirs", "on the side", "second at the same moment", "root"])
    assert Counter(subjects(engine.file_history("old"))) == Counter([*says("old"), "merge by hand"]), "git leaves merges out when it follows names"
    assert subjects(engine.file_history("c")) == ["the other a is c now", "another a"]
    assert subjects(engine.file_history("a")) == ["the other a is c now", "another a"], "the file that was called so last"
    assert subjects(engine.file_history("b")) == ["b comes anew"]
    assert set(subjects(engine.file_history("s"))) == {"after the merge", "made on the side"}
    assert set(subjects(engine.file_history("f"))) == {"after the merge", "a file of the fourth"}
    assert subjects(engine.file_history("old", follow=False)) == ["a is old now"]
    assert engine.file_history("none").count() == 0
    shown = {r.subject: r["diff"] for r in engine.file_history("old", include_diff=True).collect()}
    assert "--- a/a" in shown["ours"] and shown["a is old now"] == "" and "--- /dev/null" in shown["root"]
    assert "+line 18 s" in shown["on the side"] and "-line 1 \n" in shown["second at the same moment"]


def test_names(engine):
    ids = history.files_of(engine.commits, engine.changes, engine.placed)
    assert {r.name for r in history.names(engine.commits, ids, "old").collect()} == {"old", "a"}
    assert {r.name for r in history.names(engine.commits, ids, "c").collect()} == {"c", "a"}
    assert engine.spark is ids.sparkSession and history.file_history(engine.commits, engine.changes, "c", ids=ids, placed=engine.placed).count() == 2


def test_a_file_of_the_past_is_read_by_slim_rows(spark):
    """Texts are joined last: neither windows nor their shuffles hold them."""
    commits = spark.createDataFrame([("1", datetime(2024, 1, 1)), ("2", datetime(2024, 1, 2))], "sha string, date timestamp")
    changes = spark.createDataFrame([("1", "a", None, "A"), ("2", "a", None, "M")], "sha string, path string, old_path string, status string")
    versions = spark.createDataFrame([("1", "a", "one"), ("2", "a", "two")], "sha string, path string, content string")
    found = history.versions_of(changes, versions, changes, lineage.linear(commits))
    assert {r.sha: (r.before, r.after) for r in found.collect()} == {"1": (None, "one"), "2": ("one", "two")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan[plan.index("Window") :].split("LogicalRDD")[0]
