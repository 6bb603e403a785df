"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import cut


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """One large-star (keep_larger) or small-star step over pairs (u, v)."""
    if keep_larger:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if keep_larger:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """node, root of every node with an edge; root is the least node of its component.

    Alternates large-star and small-star steps until every edge points at a
    root.  Least neighbours are aggregated before the shuffle.  The edges of
    one node meet in one key of a join, as rows, not as a list: a node with
    many neighbours makes one task larger, unless Spark splits it at run time.
    Null ends and loops are ignored.
    """
    pairs = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").distinct())
    for _ in range(max_rounds):
        following = cut(_star(_star(pairs, True), False))
        # a forest of stars has every child once, and no root among the children
        ends = following.select("u", F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(following.select(F.col("v").alias("u"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        done = ends.groupBy("u").agg(F.sum("child").alias("n"), F.max("root").alias("root")).filter("n > 1 or n = 1 and root = 1").isEmpty()
        pairs = following
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
