"""Connected components over an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreflow.llm.scratch import dropped, kept


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every endpoint: (id, label), from undirected edges (a, b).

    Each round takes the least label among neighbours and then jumps to that label's own
    label, so the rounds grow with the logarithm of the longest path.  Every round's labels
    are a table in the shared folder.  A hub's edges are plain join rows, which adaptive
    execution splits, and are combined before the aggregation's shuffle.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    label = kept(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "round")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = label.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = label.select(F.col("id").alias("via"), F.col("label").alias("far"))
        after = kept(step.join(jump, "via", "left").select("id", "old", F.least("via", F.coalesce("far", "via")).alias("label")), "round")
        done = after.filter("label <> old").isEmpty()
        dropped(label)
        label = after
        if done:
            dropped(both)
            return label.select("id", "label")
