"""Sessions and shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for results that outlive their executor: the one that
    ``spark.checkpoint.dir`` names. A temporary folder stands in for it on a local
    master only, as in tests; on a cluster each executor would write to its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, for results that a plan uses several
    times: they are neither computed again nor lost with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
