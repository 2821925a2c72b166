"""Connected components of an edge list, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, label): the smallest node reachable.

    Each round a node takes the smallest label among its neighbours and then its label's
    own label, so that chains shorten by half.  Every round is written to the shared folder:
    no long lineage, and a lost executor repeats one round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = written(labels, "labels")
    while True:
        heard = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard")))
        own = (labels.join(heard, labels["node"] == heard["a"])
               .select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label")))
        own = written(own, "labels")
        jump = own.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = written(own.join(jump, "label", "left")
                       .select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels
