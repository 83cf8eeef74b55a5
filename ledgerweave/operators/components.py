"""Connected components by alternating large-star and small-star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.plans.checkpoint import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    Returns ``node, component``. Self loops keep their node as its own component; edges with a null end are ignored.
    Each round is two hash shuffles of at most as many edges as the round before; a hub's edges join its minimum by
    key, so adaptive execution can split a hub over tasks. The loop ends when a round changes no edge.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    current = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = current.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    current = current.where("u > v")

    def digest(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = digest(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = digest(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    labelled = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labelled.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
