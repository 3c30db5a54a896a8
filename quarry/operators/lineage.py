"""Cutting the lineage of iterative plans by checkpoints in shared storage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names, or one of our own in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        context.setCheckpointDir(root)
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that does not exist yet, below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: computed once, with sizes that later joins can go by."""
    spark = df.sparkSession
    path = new_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
