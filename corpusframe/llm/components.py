"""Connected components of a link table, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import dropped, stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest in its neighbourhood, the node included."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for each node of a link table of longs; the component is its smallest node.  A stored table."""
    edges = stored(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        step = stored(_small_star(_large_star(edges)), "links")
        dropped(edges)
        edges = step
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    # in the end every node but the smallest points to the smallest
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
    return stored(out.distinct(), "components")
