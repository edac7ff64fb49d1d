"""Incremental maintenance: snapshots, their difference, applying it, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, path: str = "path", marks: tuple[str, ...] = ("mtime", "size")) -> DataFrame:
    """(path, status): A added, D deleted, M modified (a mark differs).  An empty `before` makes all rows added."""
    same = F.lit(True)
    for m in marks:
        same = same & F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}"))
    both = before.alias("b").join(after.alias("a"), F.col(f"a.{path}") == F.col(f"b.{path}"), "full_outer")
    status = F.when(F.col(f"b.{path}").isNull(), "A").when(F.col(f"a.{path}").isNull(), "D").when(~same, "M")
    return both.select(F.coalesce(f"a.{path}", f"b.{path}").alias(path), status.alias("status")).where(F.col("status").isNotNull())


def candidates(before: DataFrame, listing: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """(path, status) of the files whose contents have to be looked at: A new, D gone, M another mtime or size, or named by `touched` (path), as what a
    repository says that has changed.  Nothing but names and marks is read."""
    found = snapshot_diff(before, listing)
    if touched is None:
        return found
    named = listing.join(touched.select("path").distinct(), "path", "left_semi").select("path", F.lit("M").alias("status"))
    return found.unionByName(named.join(found, "path", "left_anti"))


def settled(found: DataFrame, before: DataFrame, read: DataFrame) -> DataFrame:
    """(path, status) of the candidates whose content has changed; `before` and `read` have a content_hash, null of what isn't text.

    A file that is as it was, but for its moment, is no change; one that is text no more goes."""
    old, new = before.select("path", F.col("content_hash").alias("o")), read.select("path", F.col("content_hash").alias("n"))
    both = found.select("path").join(old, "path", "left").join(new, "path", "left")
    status = F.when(F.col("o").isNull() & F.col("n").isNotNull(), "A").when(F.col("o").isNotNull() & F.col("n").isNull(), "D").when(F.col("o") != F.col("n"), "M")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def carried_on(before: DataFrame, found: DataFrame, read: DataFrame) -> DataFrame:
    """The next run's snapshot: what was looked at as it is now, the rest as it was."""
    return before.join(found, "path", "left_anti").select(*before.columns).unionByName(read.select(*before.columns))


def as_changes(name_status: DataFrame, path: str = "path", old: str = "old_path", status: str = "status") -> DataFrame:
    """Renames become a deletion of the old path and a modification of the new one."""
    renamed = F.col(status).startswith("R")
    both = F.when(renamed, F.array(F.struct(F.col(old).alias("path"), F.lit("D").alias("status")), F.struct(F.col(path).alias("path"), F.lit("M").alias("status")))).otherwise(F.array(F.struct(F.col(path).alias("path"), F.substring(status, 1, 1).alias("status"))))
    return name_status.select(F.explode(both).alias("c")).select("c.*")


def apply_changes(table: DataFrame, changes: DataFrame, fresh: DataFrame, path: str = "file_path", changed: str = "path") -> DataFrame:
    """The table without the rows of changed paths, and the fresh rows of those that were not deleted."""
    touched = changes.select(F.col(changed).alias(path)).distinct()
    there = changes.where("status != 'D'").select(F.col(changed).alias(path)).distinct()
    return table.join(touched, path, "left_anti").unionByName(fresh.join(there, path, "left_semi"))


def staleness(indexed: DataFrame, head: DataFrame, version: str) -> DataFrame:
    """last_indexed, current_head, is_stale."""
    a = indexed.agg(F.max(version).alias("last_indexed"))
    return a.withColumn("current_head", head.agg(F.max(version)).scalar()).withColumn("is_stale", ~F.col("last_indexed").eqNullSafe(F.col("current_head")))
