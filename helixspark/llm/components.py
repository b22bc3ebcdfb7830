"""Connected components of an edge table by iterated joins; no edge or label leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Each round a node takes the smallest label of itself and its neighbours (minimum before the shuffle, so hubs are cheap) and
    then its label's label, which halves the length of chains. Labels are checkpointed each round; it ends when none changes.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        jumped = hooked.join(target, hooked["component"] == target["at"], "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component"))
        jumped = checkpointed(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
