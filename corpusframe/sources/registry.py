"""Repositories and their namespaces, by root folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.functions import paths


def registry(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(root, namespace)."""
    return spark.createDataFrame([(r.rstrip("/"),) for r in roots], "root string").withColumn("namespace", paths.namespace(F.col("root")))


def owner(registered: DataFrame, folders: DataFrame, folder: str = "cwd") -> DataFrame:
    """For each folder the deepest registered root that holds it: folders are expanded to their ancestors and joined by equality."""
    p = F.split(F.regexp_replace(folder, "/+$", ""), "/")
    ancestors = folders.select(folder, F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))).alias("root"))
    return ancestors.join(registered, "root").groupBy(folder).agg(F.max_by("root", F.length("root")).alias("root"), F.max_by("namespace", F.length("root")).alias("namespace"))
