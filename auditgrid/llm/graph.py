"""Connected components of an undirected graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``: the label is its component's least node.

    Labels sink to the least label next to a node and then jump to their label's label, so
    that a chain's length halves each round.  Each round is written to the shared folder:
    lineage stays short and no edge or label reaches the driver.  Without edges there are
    no rows.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        sunk = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        sunk = written(sunk, "labels")
        upper = sunk.select(F.col("node").alias("low"), F.col("low").alias("up"))
        now = written(sunk.join(upper, "low").select("node", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("moved")), "labels")
        if now.filter("moved").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")
