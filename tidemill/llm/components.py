"""Connected components of an edge table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(a, b)``.

    Each round passes the smaller label over every edge and then replaces labels by
    their own labels, so long chains shorten quickly.  Labels are aggregated before the
    shuffle, and only tables of edges and labels are kept; nothing goes to the driver
    but the number of changed labels.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct().toDF("a", "b"), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy(both.a.alias("n")).agg(F.min("component").alias("low"))
        step = labels.join(heard, F.col("node") == F.col("n")).select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        up = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        step = step.join(up, F.col("component") == F.col("root"), "left").select("node", "old", F.coalesce("above", "component").alias("component"))
        step = materialize(step, "labels")
        changed = step.where("component <> old").limit(1).count()
        release(labels)
        labels = step.select("node", "component")
        if not changed:
            release(both)
            return labels
