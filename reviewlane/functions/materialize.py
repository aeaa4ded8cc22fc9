"""Cutting lineage, and joining what may be small."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows a side is broadcast; it is counted before.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results: the session's spark.checkpoint.dir.

    Where that is unset a temporary one serves, but on one machine only: on a cluster the other
    executors could not read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="reviewlane-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; any executor can read it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def attach(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with a side that has one row a key: broadcast if its count allows, by shuffle otherwise.

    The side is materialised first. Both sides of a shuffle are then exchanged as they stand,
    so that Spark can split the rows of a frequent key.
    """
    side = checkpoint(side)
    return df.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, keys, how)
