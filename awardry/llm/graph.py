"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of the edges (u, v) can reach.

    Large-star and small-star rounds in turn, until the edges are stars about the least ids. The
    aggregations combine before their shuffle. The joins bring a hub's edges, rows of two numbers, to the
    partition of the hub, which adaptive execution splits where it is large; each round is written to the
    shared folder. Ids without edges aren't returned.
    """
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges)).where("u <> v").distinct(), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(edges.select("v", "v")).distinct()
