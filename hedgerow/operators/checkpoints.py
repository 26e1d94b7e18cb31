"""The folder that driver and executors share, and reliable checkpoints for loops over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one is made only where that is unset and all tasks run in this process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="hedgerow-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
