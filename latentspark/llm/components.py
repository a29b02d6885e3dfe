"""Connected components with Spark joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label: for every node of edges (a, b) the smallest node that it is connected with.

    Labels travel along edges and then jump to the label's own label, so that chains halve in each round;
    every round is written to the shared folder. Nodes of more than a thousandth of all edges, two thousand at most,
    send their labels by a broadcast. Loops and repeated edges are legal; no edges give no rows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both)
    n = both.count()
    hubs = stored(both.groupBy("b").count().filter(F.col("count") * 1000 > n).select("b"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        told = labels.withColumnRenamed("node", "b")
        few = F.broadcast(told.join(F.broadcast(hubs), "b"))
        along = both.join(few, "b").unionByName(both.join(F.broadcast(hubs), "b", "left_anti").join(told, "b"))
        heard = along.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.least("label", "heard").alias("next"), "label")
        there = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        new = stored(nearer.join(there, "next", "left").select("node", F.coalesce("jump", "next").alias("label"), (F.coalesce("jump", "next") != F.col("label")).alias("changed")))
        drop(labels)
        labels = new.select("node", "label")
        labels.stored_at = new.stored_at
        if new.filter("changed").isEmpty():
            drop(both, hubs)
            return labels
