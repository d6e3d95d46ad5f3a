"""Connected components by least labels, with label jumping: rounds grow with the logarithm of the widest component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of all nodes of edges (u, v)."""
    both = cut(edges.selectExpr("u", "v").union(edges.selectExpr("v", "u")).where("u is not null and v is not null").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).selectExpr("node", "least(node, least) as component"))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("old"), "near")
        # what a node hears goes to the node of its label as well, so that whole trees of labels join, not only their rims
        heard = step.select(F.inline(F.array(F.struct("node", F.least("old", "near").alias("least"), "old"), F.struct(F.col("old").alias("node"), F.col("near").alias("least"), F.lit(None).cast(labels.schema["component"].dataType).alias("old")))))
        step = heard.groupBy("node").agg(F.max("old").alias("old"), F.min("least").alias("component"))
        jump = labels.selectExpr("node as component", "component as further")
        new = cut(step.join(jump, "component", "left").selectExpr("node", "old", "least(component, further) as component"))
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
