"""Connected components of a link table by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): root is the smallest node of
    the component.  Self links and repeated links don't matter; no links give no
    rows.  Every round is two joins on a table no longer than the links; the
    number of rounds grows with the logarithm of the nodes."""
    edges = materialise(links.where("a <> b")
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct())
    while True:
        # every node hands its larger neighbours to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # every node hands its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v")).distinct())
        # a node may keep two links only if one of its roots hangs below another
        edges = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
