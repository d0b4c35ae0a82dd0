"""Connected components over an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.plans.tables import Scratch, join_skewed, remove_shared, write_shared

#: A table of no more edges goes through a round in one task; the shuffles of a larger one are dealt as the session says.
EDGES_A_TASK = 1 << 15


def _few(df: DataFrame, edges: int) -> DataFrame:
    """``df`` of counted ``edges``: in one task where a task can hold them. Not for shuffled aggregates: one task that merged their many parts took an executor over 3000 MB."""
    return df.coalesce(1) if edges <= EDGES_A_TASK else df


def _stars(edges: DataFrame, total: int) -> bool:
    """Whether every ``u`` has one edge and leads to a node that leads nowhere."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    roles = _few(ends, total).groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return roles.where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``edges`` (``a, b``).

    Alternates large-star and small-star: each step links the neighbours of a node
    to the smallest of them, so stars form in a logarithmic number of steps and no
    neighbourhood is gathered anywhere; nodes with very many neighbours are joined
    by broadcast. It ends when only stars are left. Self-loops and repeated edges are
    fine. The result is written under ``scratch``.
    """
    spark = edges.sparkSession
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    total = pairs.count()
    cur, path = write_shared(_few(pairs, total).distinct(), "components-0")
    total = cur.count()
    for k in range(rounds):
        if _stars(cur, total):
            scratch.paths.append(path)
            roots = _few(cur, total).select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = _few(cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))), total)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
        large = join_skewed(both, low, "u", "deg", 2 * total).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, path_l = write_shared(large.distinct(), f"components-{k}l")
        # now every edge leads from u to a smaller v
        large = _few(large, total)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
        joined = join_skewed(large, low, "u", "deg", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _few(joined.unionByName(low.select("u", F.col("m").alias("v"))), total).where("u != v").distinct()
        small, path_s = write_shared(small, f"components-{k}s")
        remove_shared(spark, path), remove_shared(spark, path_l)
        cur, path = small, path_s
        total = cur.count()
    raise RuntimeError(f"components did not settle in {rounds} rounds")
