"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leaguestats.checkpoints import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of
    that label, so chains shorten by doubling.  Ends when a round changes nothing.
    """
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"))
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = scratch.keep(
            labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        )
        jumped = scratch.keep(
            nearer.join(nearer.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select(
                "node", "was", F.least("label", "next").alias("label")
            )
        )
        changed = jumped.where("label <> was").isEmpty()
        scratch.drop(labels, nearer)
        labels = jumped
        if changed:
            return labels.select("node", "label")
