"""Connected components of an edge table, by min-label propagation with pointer jumping.

Labels travel by aggregations with map-side combine and by equi-joins that adaptive execution
splits when a label is hot. Every round is written to the shared folder, so lineage does not
grow. Paths shorten by half a round, so rounds grow with the logarithm of the longest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of edges (a, b: long). Self-loops are fine."""
    both = edges.select("a", "b").where("a <> b")
    links = written(both.union(both.select("b", "a")).distinct(), "links")
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        # the label of a node's label, and the labels its neighbours have
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = labels.join(jump, "label").select("node", F.col("label").alias("was"), F.col("far").alias("label"))
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        # a better label found at a node is handed to the node's old label too
        found = jumped.join(near, "node").select("node", "was", F.least("label", "seen").alias("label"))
        told = found.groupBy(F.col("was").alias("node")).agg(F.min("label").alias("told"))
        step = found.join(told, "node", "left").select("node", "was", F.least("label", F.coalesce("told", "label")).alias("label"))
        seen = Observation()  # told by the write itself
        new = written(step.observe(seen, F.count(F.when(F.col("label") != F.col("was"), 1)).alias("moved")), "labels")
        moved = seen.get["moved"]
        discard(labels)
        labels = new.drop("was")
        if not moved:
            discard(links)
            return labels.withColumnRenamed("label", "component")
