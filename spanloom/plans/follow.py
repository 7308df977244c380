"""Following references from row to row until they end."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_unsized, shared_folder

_FOUND = "root string, at string, places array<long>, state string"


def follow(roots: DataFrame, edges: DataFrame, depth: int = 1000) -> DataFrame:
    """(root, at, places, state): where the edges (at, place, to) lead from each (root, at).

    A place without edges is an ``end``; an edge back to a place of its own path is a ``cycle``
    and isn't followed. ``places`` are the edges' places on the way, so ends sort as in a walk
    in depth. All roots take their next step in the same join; what ended is written to the
    shared folder, so the plan stays as it is however deep references nest. More than
    ``depth`` steps are an error.
    """
    spark = roots.sparkSession
    folder = f"{shared_folder(spark)}/follow-{uuid4()}"
    steps = edges.select("at", "place", "to")
    current = roots.select("root", "at", F.array().cast("array<long>").alias("places"), F.array("at").alias("path"))
    for _ in range(depth + 1):
        state = F.when(F.col("to").isNull(), "end").when(F.array_contains("path", F.col("to")), "cycle").otherwise("on")
        moved = cut_unsized(current.join(steps, "at", "left").withColumn("state", state))
        done = moved.where("state <> 'on'")
        done.select("root", F.coalesce("to", "at").alias("at"), "places", "state").write.mode("append").parquet(folder)
        going = moved.where("state = 'on'")
        current = going.select("root", F.col("to").alias("at"), F.concat("places", F.array(F.col("place").cast("long"))).alias("places"), F.concat("path", F.array("to")).alias("path"))
        if current.isEmpty():
            return spark.read.schema(_FOUND).parquet(folder).hint("merge")  # the files are much smaller than their rows
    raise ValueError(f"references nest deeper than {depth}")
