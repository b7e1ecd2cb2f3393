"""Connected components of a graph of links, by labels that shrink along links and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import BROADCAST_ROWS, durable, lookup


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of ``links`` (a, b: longs).

    Every round is one aggregation of the links and one of the labels, until nothing changes, which it does as labels only
    shrink; labels are cut from their lineage each round, so a lost executor costs one round at most. While there are few nodes
    (counted first), labels are broadcast; beyond that only those of nodes with very many links, or of labels with very many
    nodes, are (``lookup``), so no task is loaded by one of them.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = durable(both)
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    small = labels.count() <= BROADCAST_ROWS
    while True:
        over = lookup(both, labels.withColumnRenamed("node", "b"), "b", small=small).groupBy("a").agg(F.min("label").alias("seen")).withColumnRenamed("a", "node")
        # The smallest label among neighbours, for the node and for the label it has now.
        step = labels.join(over, "node").select("node", "label", F.least("label", "seen").alias("low"))
        step = step if small else durable(step)
        hooked = step.groupBy("label").agg(F.min("low").alias("root_low"))
        after = lookup(step, hooked, "label", small=small).select("node", "label", F.least("low", "root_low").alias("next"))
        after = after if small else durable(after)
        tops = after.select(F.col("node").alias("next"), F.col("next").alias("top_next"))
        after = lookup(after, tops, "next", "left", small=small).select("node", "label", F.least("next", F.coalesce("top_next", "next")).alias("next"))
        after = durable(after)
        if after.filter("next != label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = after.select("node", F.col("next").alias("label"))
