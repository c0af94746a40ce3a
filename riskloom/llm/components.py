"""Connected components of links by repeated joins; nothing but a count goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import write_stage


def connected_components(links: DataFrame, most_writes: int = 30, to_the_end: bool = True) -> DataFrame:
    """``links``: columns ``a``, ``b``. Returns ``node, component`` (the smallest node of the component) for linked nodes.

    Each round gives a node the smallest label among its own and its neighbours' (a grouped minimum, combined before the
    shuffle, so a hub's many links need no single task), then the label of its label. The labels of every second round are
    a written table, so a lost executor doesn't undo earlier rounds; rounds end when no label changes. Their
    number grows with the logarithm of a component's longest path in all but contrived cases. Without ``to_the_end`` there are two rounds:
    nodes of one label are connected, but not all connected nodes have one label yet.
    """
    both = write_stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")

    def after_a_round(labels: DataFrame) -> DataFrame:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        # one jump: the label of the label, which is a node itself
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        return hooked.join(jump, "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") != F.col("component")).alias("changed"))

    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    for _ in range(most_writes):
        fresh = write_stage(after_a_round(after_a_round(labels).drop("changed")), "labels")
        labels = fresh.select("node", "component")
        if not to_the_end or fresh.where("changed").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {2 * most_writes} rounds")
