"""Connected components of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, cut=cut) -> DataFrame:
    """(node, label) of all nodes of the links (a, b); label is the smallest node of the component.

    Each round takes the smallest label among neighbours, then the label of that label, so long chains shrink
    by more than half a round. Links and labels stay distributed; every round is a written table.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        least = cut(least)
        up = least.select(F.col("node").alias("at"), F.col("low").alias("further"))
        jumped = least.join(up, least["low"] == up["at"]).select("node", "label", F.least("low", "further").alias("new"))
        jumped = cut(jumped)
        labels = jumped.select("node", F.col("new").alias("label"))
        if jumped.where("label <> new").isEmpty():
            return labels
