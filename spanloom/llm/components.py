"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; each round is written to the shared folder, so a lost executor costs one
round.  The tables hold edges only, never expanded groups.  Joins are merge joins, so that rounds over small tables leave no
broadcasts in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def settled(edges: DataFrame) -> bool:
    """Whether edges u > v are stars: every u has one edge and is the v of none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not both.where("up > 1 or up > 0 and down > 0").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: a, b (long).  Returns node, root for all nodes but the roots; a root is its component's least node."""
    held = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if settled(held):
            return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = held.select("u", "v").union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower.hint("merge"), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        following = materialize(small, "edges")
        release(held)
        held = following
    raise RuntimeError(f"components did not settle in {rounds} rounds")
