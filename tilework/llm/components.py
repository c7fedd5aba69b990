"""Connected components of an edge table that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import remove, written


def _stars(edges: DataFrame, low: bool) -> DataFrame:
    """One step: neighbours move to the smallest neighbour. low: only neighbours below the node move, and the node with them."""
    seen = edges if low else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # here every edge is seen from a; for low steps a is the larger end
    least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = seen.join(least, "a")
    if low:
        moved = joined.select("b", "m").union(least.select("a", "m"))
    else:
        moved = joined.where("b > a").select("b", "m")
    out = moved.toDF("a", "b")
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (a, b: long); component is its smallest node.

    Alternating large and small star steps (Kiveris et al. 2014): the number of
    edges never grows, and rounds are logarithmic in practice. A hub is a skewed
    join key against one row. Each round is written and
    read again, which cuts its lineage off, and the round before is removed.
    """
    now, path = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        now, after = written(_stars(_stars(now, low=False), low=True), "edges")
        remove(edges.sparkSession, path)
        path = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
