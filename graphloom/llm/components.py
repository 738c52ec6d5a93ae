"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.storage import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b longs): label is the smallest node that can be reached.

    Every round gives a node the smallest label around it and then the label of that label, so long chains shorten
    by doubling. Rounds are written tables of one row per node; nothing is gathered on the driver but a row count.
    A hot node only meets partial minima, which are combined before the shuffle.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        new = keep(
            stepped.join(jump, "next", "left").select(
                "node", F.least("next", "jumped").alias("label"), (F.least("next", "jumped") < F.col("label")).alias("moved")
            )
        )
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
