"""Cutting lineage: a frame computed once into the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the setting is missing, masters on one machine get a temporary folder and others must name one."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return (where or context.getCheckpointDir()).rstrip("/")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the one that driver and executors share."""
    return f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in spark.checkpoint.dir; what reads it twice doesn't compute it twice, and a lost executor costs a reread."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. For loops: a checkpoint keeps what was inferred of its columns, which grows with every round."""
    folder = fresh_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
