"""Connected components by smallest label with pointer jumping; lineage is cut in the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm._store import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable. edges: (a, b), long. Nodes without edges don't appear."""
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_n")).agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["_n"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = stored(step, "labels")
        up = step.select(F.col("node").alias("_n"), F.col("label").alias("up"))
        jumped = stored(step.join(up, step["label"] == up["_n"]).select("node", "old", F.least("label", "up").alias("label")), "labels")
        changed = jumped.where("old <> label").limit(1).count()
        dropped(spark, labels)
        dropped(spark, step)
        labels = jumped.select("node", "label")
        if not changed:
            dropped(spark, both)
            return labels
