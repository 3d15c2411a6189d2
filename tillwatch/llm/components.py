"""Connected components of an edge table by smallest label with shortcuts; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges(a, b): label is the smallest node of the component.

    A round takes the smallest label among a node's neighbours, then that label's own label, so long chains shrink by
    doubling. Groupings pre-aggregate, and nothing but a count of changes reaches the driver."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = stored(step, "labels")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = stored(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        changed = after.where("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
