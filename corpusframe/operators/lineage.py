"""Which version of a file a change was made to, and which changes are of one file over time, by ancestry and not by date.

Commits form a forest of first parents, and a commit's tree is that of its first parent with its changes.  `placed` tables deal the commits into chains:
paths of first parents, each with places that grow towards the tips.  So the version that a commit finds is the last change of the file at or before the
parent's place in its chain, or else in the chain that this one branches off, and so on; a round of windows for each level of branching.  Only names
and numbers move; texts are joined by those who want them.

    placed    sha, chain, place[, parent]     without `parent` there is one chain, in the order of places
    changes   sha, path, old_path, status[, taken_from]     against the first parent; `taken_from`: the parent that a merge has the file from
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusframe.sources.session import new_folder

#: So many renamings in a row are followed name by name, in each direction; beyond that all changes are taken.
FOLLOWED = 24

#: Of one place and name: a question before it, the end of a name that a renaming leaves, the change itself, a question after it.
BEFORE, LEFT, CHANGED, AFTER = 0, 1, 2, 3


def held(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder that the cluster names, which cuts the lineage of a loop."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.sparkContext.setCheckpointDir(given)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The rows in a new folder beside the checkpoints, read again, for loops of joins.

    `checkpoint()` cuts the lineage but hands on the plan's estimate of its size, and that of a join is the product of its sides': in a loop of joins the
    number's digits multiply with each round, until the driver does nothing but multiply.  Files have a size of their own, and are worked out once."""
    folder = new_folder(df.sparkSession, "lineage")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def linear(commits: DataFrame) -> DataFrame:
    """Placed commits where no parents are known: one chain, by date."""
    return commits.select("sha", F.lit(0).alias("chain"), F.struct("date", "sha").alias("place"))


def placed(parents: DataFrame) -> DataFrame:
    """Placed commits from (sha, parent) rows, the parent null or unknown in a root.

    A chain is named by the deepest commit above its commits (the largest name among those), so the longest path stays in one piece and branches are short.
    Found by doubling: a round looks twice as far, so there are as many as the logarithm of the longest path."""
    known = parents.select(F.col("sha").alias("parent")).distinct()
    edges = parents.select("sha", "parent").join(known, "parent", "left_semi").select("sha", "parent")
    first = parents.select("sha").distinct().join(edges, "sha", "left")
    now = kept(first.select("sha", "parent", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("place"), F.struct(F.lit(0).cast("long").alias("height"), F.col("sha").alias("tip")).alias("best")))
    reach = 1
    while not now.where("up IS NOT NULL").isEmpty():
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("sha")).agg(F.max(F.struct((F.col("best.height") + reach).alias("height"), F.col("best.tip").alias("tip"))).alias("found"))
        further = now.select(F.col("sha").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        both = now.join(below, "sha", "left").join(further, "up", "left")
        now = kept(
            both.select(
                "sha", "parent", F.col("next").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.greatest("best", "found").alias("best")
            )
        )
        reach *= 2
    return now.select("sha", F.col("best.tip").alias("chain"), "place", "parent")


def one_each(changes: DataFrame) -> DataFrame:
    """One row for each commit and path; of several the largest."""
    more = [c for c in ("taken_from",) if c in changes.columns]
    best = changes.groupBy("sha", "path").agg(F.max(F.struct("status", "old_path", *more)).alias("x"))
    return best.select("sha", "path", "x.*")


def under_names(changes: DataFrame, path: str) -> DataFrame:
    """The changes that the history of the file that is or was called `path` can depend on: those under names from which renamings and copies lead to that
    one, and under names that they lead to from there.  `identified` finds the same changes of this file among them as among all.

    A file's changes, from its first on, are all under such names, and so is what a renaming leaves.  Under one of them there may be other files too, whose
    earlier names are left out; they get another `file_id` than among all changes, and never that of a file which is here from its first change on.
    A round is a step between names; of very long lines of names no end is waited for, and then nothing is left out."""
    pairs = kept(changes.where("old_path <> '' AND path <> old_path").select("old_path", "path").distinct())
    found = pairs.sparkSession.range(1).select(F.lit(path).alias("name"))
    for here, there in (("path", "old_path"), ("old_path", "path")):
        fresh = found
        for _ in range(FOLLOWED):
            step = pairs.join(fresh, F.col(here) == F.col("name"), "left_semi").select(F.col(there).alias("name")).distinct()
            fresh = kept(step.join(found, "name", "left_anti"))
            if fresh.isEmpty():
                break
            found = found.union(fresh)
        else:
            return changes
    return kept(changes.join(kept(found), F.col("path") == F.col("name"), "left_semi"))


def is_renaming() -> Column:
    return F.col("status").startswith("R") & F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path"))


def linked(changes: DataFrame, placed: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(sha, path, old_path, status, chain, place, before): `before` is the change that made the version that this one found under its (old) name,
    struct<sha, path, live, chain>, or null; what isn't live is a deletion, or a name that a renaming has left.  `of` are the changes that are asked about, by default all.

    A commit that `placed` doesn't know, or a table without rows, gives no rows."""
    changes = one_each(changes)
    wanted = changes if of is None else changes.join(of.select("sha", "path").distinct(), ["sha", "path"], "left_semi")
    found_as = F.coalesce(F.when(F.col("old_path") != "", F.col("old_path")), F.col("path"))
    what = lambda name, live, kind: F.struct(name.alias("name"), live.alias("live"), F.lit(kind).alias("kind"))
    each = F.array(what(F.col("path"), ~F.col("status").startswith("D"), CHANGED), F.when(is_renaming(), what(F.col("old_path"), F.lit(False), LEFT)))
    at = placed.select("sha", "chain", "place")
    known = changes.join(placed, "sha")
    named = known.select("sha", "chain", "place", F.explode(each).alias("x")).where("x IS NOT NULL").select("sha", "chain", "place", "x.*")
    if of is not None:
        named = named.join(wanted.select(found_as.alias("name")).distinct(), "name", "left_semi")
    # `path` of an event is the name under which it left the file: its own
    events = named.select("chain", "name", "place", "kind", F.struct("sha", F.col("name").alias("path"), "live", "chain").alias("event"))
    rows = known if of is None else wanted.join(placed, "sha")
    if "parent" not in placed.columns:
        # each row asks once, and is answered in one go: it goes with its question
        asked = rows.select("chain", found_as.alias("name"), "place", F.lit(BEFORE).alias("kind"), F.struct("sha", "path", "old_path", "status", "place").alias("asked"))
        return _answers(events, asked).select("asked.sha", "asked.path", "asked.old_path", "asked.status", "chain", "asked.place", F.when(F.col("asked.path").isNotNull(), F.col("found")).alias("before"))
    there = at.select(F.col("sha").alias("from"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    origin = F.coalesce("taken_from", "parent") if "taken_from" in rows.columns else F.col("parent")
    asked = rows.withColumn("from", origin).join(there, "from").select(F.col("to_chain").alias("chain"), found_as.alias("name"), F.col("to_place").alias("place"), F.lit(AFTER).alias("kind"), F.struct("sha", "path").alias("asked"))
    bases = placed.join(there, F.col("parent") == F.col("from")).where("chain != to_chain").select("chain", "to_chain", "to_place")
    events, done = kept(events), []
    while True:
        answers = kept(_answers(events, asked))
        done.append(answers.where("found IS NOT NULL").select("asked.*", F.col("found").alias("before")))
        open_still = answers.where("found IS NULL").join(bases, "chain")
        if open_still.isEmpty():
            break
        asked = open_still.select(F.col("to_chain").alias("chain"), "name", F.col("to_place").alias("place"), F.lit(AFTER).alias("kind"), "asked")
    found = reduce(lambda a, b: a.unionByName(b), done)
    return rows.join(found, ["sha", "path"], "left").select("sha", "path", "old_path", "status", "chain", "place", "before")


def _answers(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Each question with the last event at its place or before it, in one window for a chain and name."""
    both = events.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("chain", "name").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("event", ignorenulls=True).over(upto)).where("asked IS NOT NULL").select("chain", "name", "asked", "found")


def identified(links: DataFrame) -> DataFrame:
    """Adds `file_id`, which all changes of one file have, under whatever names, to the rows of `linked` over all changes.

    A name's changes on one chain fall into intervals: one begins where a file is made, comes by renaming, or is first changed on a branch.  Intervals are
    linked to the ones that they come from, and the first of each line names the file, by the change that made it.  A copy is a file of its own, and so is one
    that gets the name of another that is gone."""
    goes_on = F.col("before.live") & (F.col("before.path") == F.col("path")) & (F.col("before.chain") == F.col("chain")) & ~F.col("status").startswith("C")
    begins = ~F.coalesce(goes_on, F.lit(False))
    upto = Window.partitionBy("chain", "path").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = kept(links.withColumn("first", F.last(F.when(begins, F.col("sha")), ignorenulls=True).over(upto)))
    starts = rows.where("first = sha")
    comes = F.col("before.live") & ~F.col("status").startswith("C")
    edges = starts.select(F.struct("sha", "path").alias("own"), F.when(comes, F.struct("before.sha", "before.path")).alias("from"))
    of = rows.select(F.struct("sha", "path").alias("from"), F.struct(F.col("first").alias("sha"), "path").alias("up"))
    now = kept(edges.join(of, "from", "left").select("own", F.coalesce("up", "own").alias("up")))
    while True:
        further = now.select(F.col("own").alias("up"), F.col("up").alias("next"))
        following = kept(now.join(further, "up").select("own", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        now = following.drop("moved")
        if following.where("moved").isEmpty():
            break
    ids = now.select(F.col("own.sha").alias("first"), F.col("own.path").alias("path"), F.concat_ws(":", "up.sha", "up.path").alias("file_id"))
    return rows.join(ids, ["first", "path"]).select(*links.columns, "file_id")
