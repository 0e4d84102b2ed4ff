"""Connected components of a table of links by least labels and pointer jumping, in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskflow.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the least node that links reach.

    Every round takes the least label among a node's neighbours, then the label of that label; both grow the distance
    that labels have travelled, so rounds are about the logarithm of the longest chain. Each is written to the shared
    folder. Minima are combined before the shuffle, and a node with very many links is split by adaptive joins.
    """
    both = common.materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = common.materialise(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = common.materialise(low.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        common.discard(labels)
        labels = moved.select("node", "label")
        if not moved.where("old <> label").limit(1).take(1):
            common.discard(both)
            return labels
