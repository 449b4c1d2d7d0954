"""Connected components of a link table, by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) for every node; the label is the least node of its component.

    ``nodes`` has one column ``node``, ``links`` has ``a`` and ``b``. A round takes the least
    label of all neighbours (aggregated before the shuffle, so hubs do no harm) and then the
    label of that label; each round is written to the shared folder. Links never reach the driver.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = materialise(step, "step")
        parent = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = materialise(step.join(parent, "label").select("node", "old", F.col("jump").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
