"""Cutting of lineage before a table is used several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session runs in one process and names no folder.
LOCAL_FOLDER = "file:///tmp/checkpoints/graphloom-core"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint where the session names a folder for them (it survives lost executors), else a cached table."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


#: Keys that are sent to all tasks at most.
FEW_KEYS = 100_000


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows with one of the keys; the keys are counted, and sent to where the rows are read if they are few."""
    keys = cut(keys.select(key).distinct())
    return rows.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, key, "left_semi")


#: Vectors that are sent to all tasks at most.
FEW_VECTORS = 50_000


def lent(rows: DataFrame, vectors: DataFrame, **names: str) -> DataFrame:
    """Rows with vectors (vec, v) for columns of their keys (key="name"); they are counted, and sent to the rows if they are few."""
    few = vectors.count() <= FEW_VECTORS
    for key, name in names.items():
        one = vectors.select(F.col("vec").alias(key), F.col("v").alias(name))
        rows = rows.join(F.broadcast(one) if few else one, key)
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one under /tmp in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, read back: lost executors cost lost tasks only."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
