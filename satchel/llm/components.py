"""Connected components of an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the least node that it reaches.

    Each round a node takes the least label among its neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of a path's length at most times
    the few rounds that a star needs.  Nothing is collected but a count of changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stage(both, "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        least = least.join(jump, "comp", "left").select("node", "old", F.least(F.col("comp"), F.coalesce("next", "comp")).alias("comp"))
        least = stage(least, "labels")
        changed = least.where("old != comp").limit(1).count()
        labels = least.drop("old")
        if not changed:
            return labels
