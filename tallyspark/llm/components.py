"""Connected components of an edge table, by labels that shrink and shortcuts between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round gives a node the smallest label among its neighbours and then its label's own label, so stars and chains
    collapse in about log(length) rounds. Minima are combined before the shuffle, every round is a written table, and the
    driver sees one count for each. A round's table is dropped when the next is written; the last one is the result.
    """
    scratch = Scratch()
    both = edges.select("a", "b").where("a <> b")
    both = scratch.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    last = labels
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        after = scratch.write(
            lower.join(jump, "component").select("node", "old", F.least("component", "jump").alias("component")), "labels")
        changed = after.where("old <> component").limit(1).count()
        scratch.drop(last)
        last, labels = after, after.select("node", "component")
        if not changed:
            scratch.drop(both)
            return labels
