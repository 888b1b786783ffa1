"""Connected components of an edge table, all of it in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node that links (columns a, b) reach, for every node that has a link.

    Each round a node takes the least label of its neighbours and then that label's own label, so chains halve. Tables
    in the shared folder cut the lineage. A hub's label is one row that joins many; nothing is gathered by node.
    """
    both = edges.select("a", "b").where("a <> b")
    both = both.union(both.select("b", "a")).distinct()
    both = scratch.write(both, f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        hop = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        step = step.join(hop, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component"))
        turn += 1
        step = scratch.write(step, f"{name}-{turn}")
        changed = step.where("old <> component").limit(1).count()
        if turn > 1:
            scratch.drop(f"{name}-{turn - 1}")
        labels = step.select("node", "component")
        if not changed:
            return labels
