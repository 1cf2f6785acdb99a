"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and joins on node keys, so no component is ever gathered in one
task.  Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("_u")).where(F.col("v") > F.col("u")) \
        .select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
    moved = down.join(least, F.col("u") == F.col("_u")).where(F.col("v") != F.col("m")) \
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node it reaches) for every node of ``edges`` (u, v)
    that is not itself the smallest of its component."""
    now, seen = written(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, seen = written(_small_star(_large_star(now)), "edges"), mark
