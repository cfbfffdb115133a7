"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.llm.common import stored


def component_labels(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of all nodes in ``links``.

    ``links`` has the columns ``a`` and ``b``. Rounds of two steps: every node links its
    larger neighbours to the smallest node it sees, then every node links all its smaller
    neighbours and itself to the smallest one. The links end as stars around the smallest
    nodes. Rounds grow with the logarithm of the size; each is stored, which cuts lineage
    and survives lost executors. Only a count of changes comes to the driver. A step sees
    a node's neighbours as rows joined to one minimum, never as a list, so a node of many
    links can be split.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "component-links",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = stored(
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct(),
            "component-large",
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small = stored(small, "component-small")
        # The same links as before a round: stars.
        changed = small.join(edges, ["a", "b"], "left_anti").union(edges.join(small, ["a", "b"], "left_anti"))
        if changed.isEmpty():
            break
        edges = small
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return nodes.unionByName(centres)
