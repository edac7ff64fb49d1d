"""Change history as tables: commits, file changes, versions."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.functions import paths
from corpusframe.operators import lineage

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_629_800, "year": 31_557_600}


def moment(said: str, as_of: datetime) -> datetime:
    """`7 days ago`, `yesterday`, `now` or an ISO date, against a given moment."""
    text = said.strip().lower().replace(".", " ")
    if text in ("now", "today"):
        return as_of
    if text == "yesterday":
        return as_of - timedelta(days=1)
    m = re.fullmatch(r"(\d+|an?)\s+(second|minute|hour|day|week|month|year)s?(?:\s+ago)?", text)
    if m:
        return as_of - timedelta(seconds=(1 if m[1] in ("a", "an") else int(m[1])) * _UNITS[m[2]])
    return datetime.fromisoformat(said.strip().replace("Z", "+00:00")).replace(tzinfo=None)


def search_commits(commits: DataFrame, changes: DataFrame | None = None, query: str | None = None, author: str | None = None, since: datetime | None = None, until: datetime | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
    """Commits newest first: message and author by regular expression (any case), a range of dates, a touched path."""
    if query:
        commits = commits.where(F.col("subject").rlike(f"(?i){query}"))
    if author:
        commits = commits.where(F.col("author_name").rlike(f"(?i){author}") | F.col("author_email").rlike(f"(?i){author}"))
    if since is not None:
        commits = commits.where(F.col("date") >= F.lit(since))
    if until is not None:
        commits = commits.where(F.col("date") <= F.lit(until))
    if path:
        commits = commits.join(changes.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")).select("sha"), "sha", "left_semi")
    return commits.orderBy(F.desc("date"), "sha").limit(limit)


def by_sha(commits: DataFrame, sha: str) -> DataFrame:
    if not re.fullmatch(r"[0-9a-fA-F]{4,40}", sha):
        raise ValueError("a commit is named by 4 to 40 hexadecimal digits")
    return commits.where(F.col("sha").startswith(sha.lower()))


def unified_diff(before: str | None, after: str | None, old: str | None, new: str | None, context: int = 3) -> str:
    a, b = (before or "").splitlines(), (after or "").splitlines()
    names = (f"a/{old or new}" if before is not None else "/dev/null", f"b/{new or old}" if after is not None else "/dev/null")
    return "\n".join(difflib.unified_diff(a, b, *names, n=context, lineterm=""))


def diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """Adds `diff` to (path, old_path, before, after, ...): a diff is a computation over lines, so this is a pandas UDF."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new, before, after in parts:
            yield pd.Series([unified_diff(b, a, o, n, context) for o, n, b, a in zip(old, new, before, after, strict=True)])

    return pairs.withColumn("diff", run("old_path", "path", "before", "after"))


def own(changes: DataFrame) -> DataFrame:
    """What commits changed themselves: of a merge only the files that differ from each of its parents."""
    return changes.where("taken_from IS NULL") if "taken_from" in changes.columns else changes


def commit_diff(commits: DataFrame, changes: DataFrame, sha: str, versions: DataFrame | None = None, context: int = 3, placed: DataFrame | None = None) -> DataFrame:
    """A commit's metadata with its files: array<struct<path, old_path, status[, diff]>>, and files_changed."""
    one = by_sha(commits, sha)
    files = own(changes).join(one.select("sha"), "sha", "left_semi")
    parts = ["path", "old_path", "status"]
    if versions is not None:
        files = diffs(versions_of(files, versions, changes, placed if placed is not None else lineage.linear(commits)), context)
        parts.append("diff")
    listed = files.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("files"), F.count("*").alias("files_changed"))
    return one.join(listed, "sha", "left").fillna(0, ["files_changed"])


def versions_of(files: DataFrame, versions: DataFrame, changes: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds `after`, the file's text in the commit (null if it deletes the file), and `before`, the text that the commit found, as its first parent has it.

    With texts by `blob`, whose names are in the changes' before_blob and after_blob, those are joined and nothing else; with texts by (sha, path) the version is
    found by ancestry (`lineage.linked`).  Texts are joined last, once for each side."""
    keep = [c for c in files.columns if c not in ("before", "after")]
    if "blob" in versions.columns:
        text = lambda side: versions.select(F.col("blob").alias(f"{side}_blob"), F.col("content").alias(side))
        return files.join(text("before"), "before_blob", "left").join(text("after"), "after_blob", "left").select(*keep, "before", "after")
    links = lineage.linked(changes, placed, files).select("sha", "path", F.when(F.col("before.live"), F.col("before.sha")).alias("b_sha"), F.when(F.col("before.live"), F.col("before.path")).alias("b_path"))
    before = versions.select(F.col("sha").alias("b_sha"), F.col("path").alias("b_path"), F.col("content").alias("before"))
    after = versions.select("sha", "path", F.col("content").alias("after"))
    found = files.join(links, ["sha", "path"], "left").join(before, ["b_sha", "b_path"], "left").join(after, ["sha", "path"], "left")
    return found.select(*keep, "before", F.when(~F.col("status").startswith("D"), F.col("after")).alias("after"))


def summary(changes: DataFrame, key: str = "sha", delta: str | None = None) -> DataFrame:
    """files_changed, and the sum of a measure, for each commit."""
    return changes.groupBy(key).agg(F.count("*").alias("files_changed"), *([F.sum(delta).alias("delta")] if delta else []))


def files_of(commits: DataFrame, changes: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """All changes with the `file_id` of the file they are of (`lineage.identified`).  A table of its own where histories are asked for often; for one
    file the changes of `lineage.under_names` are enough."""
    return lineage.identified(lineage.linked(changes, placed if placed is not None else lineage.linear(commits)))


def of_one_file(ids: DataFrame, path: str) -> DataFrame:
    """The changes of the file that had a name last (by place, not by date), under all its names."""
    last = ids.where(F.col("path") == path).orderBy(F.desc("place"), F.desc("sha")).limit(1).select("file_id")
    return lineage.kept(ids.join(F.broadcast(last), "file_id", "left_semi"))  # one row; as files the changes have their size, and commits needn't be moved to them


def names(commits: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """(name, last): the names that a file has had, and the date of its last change under each."""
    return of_one_file(ids, path).join(commits.select("sha", "date"), "sha").groupBy(F.col("path").alias("name")).agg(F.max("date").alias("last"))


def file_history(
    commits: DataFrame, changes: DataFrame, path: str, limit: int = 15, follow: bool = True, versions: DataFrame | None = None, context: int = 3, placed: DataFrame | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Commits that touch a file, newest first, also under its earlier names (not those of other files that had one of its names); with the
    commit before each and, where `versions` are given, the file's `diff` in each.  `ids` is a stored table of `files_of`."""
    placed = placed if placed is not None else lineage.linear(commits)
    near = changes
    if follow:
        if ids is None:
            near = lineage.under_names(changes, path)
            ids = files_of(commits, near, placed)
        touched = of_one_file(ids, path).select("sha", "path", "place")
    else:
        touched = changes.where(F.col("path") == path).select("sha", "path").distinct().join(placed.select("sha", "place"), "sha")
    rows = own(near).select("sha", "path", "status").dropDuplicates(["sha", "path"])
    touched = rows.join(touched, ["sha", "path"])
    order = Window.orderBy("date", "place", "path")  # one file's commits only
    out = commits.join(touched, "sha").withColumn("previous_sha", F.lag("sha").over(order)).orderBy(F.desc("date"), F.desc("place"), F.desc("path")).limit(limit)
    added = ["path", "status", "previous_sha"]
    if versions is not None:
        files = own(changes).join(out.select("sha", "path"), ["sha", "path"], "left_semi")
        shown = diffs(versions_of(files, versions, changes, placed), context).select("sha", "path", "diff")
        out = out.join(shown, ["sha", "path"]).orderBy(F.desc("date"), F.desc("place"), F.desc("path"))
        added.append("diff")
    return out.select(*[c for c in commits.columns if c != "path"], *added)


def capped(diff, lines: int):
    """At most some lines of a diff, and a note on the rest."""
    parts = F.split(diff, "\n")
    more = F.size(parts) - lines
    return F.when(more <= 0, diff).otherwise(F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines)")))


def touched_modules(changes: DataFrame) -> DataFrame:
    return changes.groupBy("sha").agg(F.array_sort(F.collect_set(paths.module(F.col("path")))).alias("modules"))
