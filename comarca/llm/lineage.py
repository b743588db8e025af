"""Cutting lineage with files that all executors can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Only where that is unset on a local master (tests) a temporary
    folder is made and set; elsewhere executors couldn't read it, which is an error.

    What is written there belongs to results that are still to be read, so it stays; the folder is the
    cluster's to clear once they are."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if conf is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(conf or tempfile.mkdtemp(prefix="comarca-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder as a checkpoint; what follows reads it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder.

    Unlike a checkpoint its size is known to the planner, which then broadcasts it only where it
    measures below Spark's threshold, and joins by shuffle where it does not.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
