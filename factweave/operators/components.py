"""Connected components by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave.functions.storage import cut, released


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, settle: bool = True) -> DataFrame:
    """Return ``node, component`` for every node of ``links``; component is the smallest node reachable.

    Null ends and self-loops add nothing. Each round is two equi-joins and a grouped minimum;
    the labels are checkpointed so that plans stay short and survive lost executors.
    An empty input gives an empty output. Without ``settle`` exactly ``rounds`` rounds are made and nothing is counted:
    nodes of one label are then surely connected, but a component may still have several labels.
    """
    one_way = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = cut(one_way.unionByName(one_way.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("component")))
    for k in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # pointer jumping: a node takes over the label of its label
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = (released if k % 2 else cut)(lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = after.select("node", "component")
        if settle and after.where("component < old").isEmpty():
            return labels
    if settle:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels
