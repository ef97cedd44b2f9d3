"""The folder that all executors share: checkpoints that cut lineage in loops, and scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base or os.path.join(tempfile.gettempdir(), "checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written by checkpoint() to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_base(spark))
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
