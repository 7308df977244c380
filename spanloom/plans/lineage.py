"""Cutting a plan: results written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A local session without one (tests on one machine) gets a temporary folder; on a cluster
    nothing local would do, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    What follows reads these files, so a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """As :func:`cut`, without the size that Spark estimated for ``df``.

    That estimate comes from compressed files before they are unfolded, so a table many times as large can seem
    small enough to be broadcast, which means through the driver whole. Without one a join
    is planned as a shuffle, and adaptive execution broadcasts what it has measured to be small.
    """
    spark = df.sparkSession
    done = cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
