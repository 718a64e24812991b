"""Connected components of an edge table: least labels move along edges until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, written


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``edges``: a, b.  Returns node, root with a component's least node as its root.

    Each round takes the least label among a node and its neighbours, then the label of that label, so paths halve.  Rounds
    are written to the shared folder, so plans stay short and executors may be lost.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("_near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_mid"))
        jump = labels.select(F.col("node").alias("_j"), F.col("root").alias("_far"))
        new = written(moved.join(jump, moved["_mid"] == jump["_j"], "left").select("node", "_old", F.least("_mid", F.coalesce("_far", "_mid")).alias("root")), "labels")
        release(labels)
        labels = new
        if not new.where("root <> _old").take(1):
            release(both)
            return new.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
