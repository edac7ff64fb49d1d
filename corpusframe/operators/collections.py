"""Collections as DataFrames: lookup, upsert, change feeds, counts, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, keys: list | DataFrame) -> DataFrame:
    """Rows by key; a list becomes a pushed-down filter, a table a semi join."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(keys))


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that with the largest order; a map-side combined maximum instead of a sort."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__o"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)])).alias("best"))
    return best.select(key, *[F.col(f"best.__{i}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def apply_feed(df: DataFrame, key: str, order: str, action: str, delete: str = "DELETE") -> DataFrame:
    """The state after a feed of changes: the newest row of each key, unless it is a deletion."""
    return newest(df, key, order).where(F.col(action) != delete)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old rows whose key is not among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def prior(sources: list[DataFrame], key: str) -> DataFrame:
    """The union of several sources; of a key that stands in several, the earliest source's row."""
    ranked = [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b), ranked)
    return newest(both.withColumn("__rank", -F.col("__rank")), key, "__rank").drop("__rank")


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return wanted.join(there, key, "left_anti")


def statistics(df: DataFrame) -> DataFrame:
    """doc_count, and file_count of what is read."""
    files = len(df.inputFiles())
    return df.agg(F.count("*").alias("doc_count")).withColumn("file_count", F.lit(files))
