"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): label is the least node that edges lead to. Nodes without edges have no row.

    Each round takes the least label of a node's neighbours and then that label's own label, so paths
    shorten by half; a hub's labels are pre-aggregated before the shuffle. Labels are written to the
    shared folder after each round. Nothing is gathered on the driver but the number of changes.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = materialise(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).select(F.col("u").alias("node"), F.col("l").alias("label"))
    labels = materialise(labels, "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "m").alias("m"))
        jump = labels.select(F.col("node").alias("t"), F.col("label").alias("tl"))
        step = step.join(jump, step.m == jump.t, "left").select("node", F.least("m", F.coalesce("tl", "m")).alias("new"), "label")
        step = materialise(step, "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels
