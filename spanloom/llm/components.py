"""Connected components of a graph given as edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v); comp is the component's smallest node.

    Alternates large-star (larger neighbours go to the smallest neighbour) and small-star
    (smaller neighbours and the node itself do) until no edge changes; every round is a
    minimum with partial aggregation and a join, and is cut to the shared folder. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    current = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = _both(current)
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        current = cut(small)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
