"""Connected components by repeated least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textquarry.session import cut


def connected(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b) to (node, label), the least node of the component. Each round
    takes the least label of the neighbours and then that label's own label."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = cut(step.join(own, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = after.where("old != label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
