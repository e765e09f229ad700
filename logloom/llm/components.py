"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``u, v`` (long); a component is named by its least node.

    Each round is written to the shared folder, so a lost executor repeats one round at
    most. Rounds grow with the logarithm of the longest path. Loops and repeated edges do
    no harm; no edges give no rows.
    """
    now, state = stage(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        now = stage(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if seen == state:
            break
        state = seen
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
