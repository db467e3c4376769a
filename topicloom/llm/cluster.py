"""Lineage cuts in the shared folder, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a few narrow columns that may be broadcast; a larger side is joined by shuffle.
BROADCAST_ROWS = 500_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Where none is set, a temporary one on a single machine; an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a checkpoint in the shared folder (see checkpoint_folder)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (already cheap to read, such as a checkpoint) with a broadcast hint if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input is in fewer parts than that; larger inputs stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.select(*columns) if columns else table
