"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); label is the smallest node reachable.

    Each round every node takes the smallest label beside it and then its label's label, so the rounds grow with the logarithm
    of the longest path. Labels are written to the shared folder each round; only a count reaches the driver. A hub's rows are
    pre-aggregated before they are shuffled."""
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        # the label's own label of this round or the last one: both are reachable and not larger
        step = step.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        step, used = settle(step), labels
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        drop_settled(used)
        if not changed:
            return labels
