"""Connected components as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, joined_apart, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for the nodes of links; root is the smallest node that can be reached.

    A round takes the smallest label among a node's neighbours, then that label's own label, so a chain of n
    links needs about log n rounds. Every round is written to the shared folder: its lineage is one read. A node with
    most of the links, or a label that most nodes have, is joined apart from the others.
    """
    both = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(links.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = joined_apart(both, labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        least = stored(labels.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "seen").alias("label")), "labels")
        ahead = labels.select(F.col("node").alias("label"), F.col("root").alias("further"))
        moved = stored(joined_apart(least, ahead, "label").select("node", "before", F.least("label", "further").alias("root")), "labels")
        forget(least, labels)
        if moved.filter("root <> before").isEmpty():
            forget(both)
            return moved.select("node", "root")
        labels = moved
