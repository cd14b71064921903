"""Connected components of an edge table by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` long -> ``(v, root)``, ``root`` the smallest vertex reachable.

    Each round lowers every label to the smallest label next to it and then
    follows that label's own label (pointer jumping), until nothing changes.
    Rounds are written to the shared checkpoint folder.  Hub vertices are
    pre-aggregated by the partial minimum, and the joins are plain equi-joins
    that adaptive execution splits when a hub is hot.
    """
    both = edges.select("a", "b").filter("a <> b")
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("v"), F.least("a", "m").alias("root"))
    labels = materialize(labels)
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy("a").agg(
            F.min("root").alias("near"))
        lowered = labels.join(near.withColumnRenamed("a", "v"), "v").select(
            "v", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("root").alias("next"))
        step = materialize(lowered.join(jump, "low").select(
            "v", "old", F.least("low", "next").alias("root")))
        labels = step.select("v", "root")
        if step.filter("root <> old").isEmpty():
            return labels
