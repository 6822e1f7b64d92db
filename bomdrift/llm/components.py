"""Connected components of a link table, by least labels and pointer jumping in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomdrift.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from every node of links (a, b); each round is a written table."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    both = written(both, "links")
    label = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        root = label.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = (
            label.join(near, "node").join(root, "component")
            .select("node", F.least("near", "root").alias("to"), "component")
        )
        following = written(jumped.select("node", F.least("to", "component").alias("component"), (F.col("to") < F.col("component")).alias("moved")), "labels")
        label = following.select("node", "component")
        if not following.where("moved").head(1):
            return label
