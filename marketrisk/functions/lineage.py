"""Cutting lineage where a table feeds many jobs (model fits, reports)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="marketrisk-checkpoint-")
    context.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder and read from there.

    Survives lost executors without recomputation, and takes one job where ``DataFrame.checkpoint`` computes its rows twice.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
