"""Connected components by label propagation over settled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the smallest node
    reachable. Each round takes the least label among the neighbours and then
    follows the label's own label, so chains shrink by halves. Every table is
    written to the shared folder; the driver sees one count a round."""
    both = settle(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = settle(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        moved = settle(
            labels.join(near, "u").select("u", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("new")), "moved"
        )
        if moved.filter("new").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
        jump = moved.select(F.col("u").alias("c"), F.col("c").alias("root"))
        labels = settle(moved.join(jump, "c").select("u", F.least("c", "root").alias("c")), "labels")
