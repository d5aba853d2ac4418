"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, spread_join, write


def _least(edges: DataFrame) -> DataFrame:
    """u, m, n: each node with the least of itself and its neighbours, and how many edges it has."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return spread_join(both, _least(both), "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = spread_join(down, least, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node that has an edge, with the least node of its component.

    ``edges`` has long columns u and v. Each step is written to the shared
    folder, so the lineage stays short, and the step before is deleted; rounds
    grow with the logarithm of the longest path. A node of very many edges (the
    centre of a star) has its edges dealt over tasks. To the driver come two
    numbers a round and the bounded list of such nodes.
    """
    spark, path = edges.sparkSession, None

    def step(df: DataFrame) -> DataFrame:
        nonlocal path
        old, path = path, write(df)
        if old:
            discard(spark, old)
        return spark.read.schema("u long, v long").parquet(path)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = step(edges.select("u", "v").where("u <> v").distinct())
    seen = state(now)
    while seen[0]:
        before = seen
        now = step(_large_star(now, seen[0]))
        now = step(_small_star(now, now.count()))
        seen = state(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
