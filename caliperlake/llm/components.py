"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, label): the least node of each component; nodes without an edge have no row.

    A round gives each node the least label around it and then the label of that label, so chains shorten
    by at least half.  Each round is written to the shared folder.
    """
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        near = labels.join(around, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        moved = materialise(near.join(jump, F.col("mid") == F.col("_at")).select("node", "old", F.least("mid", "_to").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels
