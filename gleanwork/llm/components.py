"""Connected components by minimum labels with pointer jumping, each round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.shared import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long): label is the least node of its component.

    Minima are combined before each shuffle, so a node with very many neighbours gathers nowhere.
    Labels only fall, and each round also replaces a label by its label's label, so rounds grow
    with the logarithm of the longest path in practice. Self-loops make isolated nodes.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "component-labels")
    held = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("beyond"))
        new = materialise(step.join(jump, "new", "left").select("node", F.least("new", "beyond").alias("label"), "old"), "component-labels")
        changed = new.where("label <> old").limit(1).count()
        release(held)
        held, labels = new, new.select("node", "label")
        if not changed:
            release(both)
            return labels
