"""Connected components of an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.session import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node in a, b.

    Each round takes the least label among the neighbours and then that label's
    own label; every round is written to the shared folder, and the one before
    is deleted. No edge, no row.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        least = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(least, labels["node"] == least["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = materialise(hooked.join(jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("beyond", "next")).alias("label")))
        release(labels)
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            release(both)
            return moved
        labels = moved
