"""Where intermediate tables go, and reading of input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session runs in one process and names no folder.
LOCAL_FOLDER = "file:///tmp/checkpoints/graphloom"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Unset in a local session, a folder under /tmp is set; unset on a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_FOLDER
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with every column but the used ones under a name that no operator has, and the columns that give it back."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    names = [c if c in used else f"user column {i}" for i, c in enumerate(docs.columns)]
    return docs.select(*(F.col(q).alias(n) for q, n in zip(quoted, names, strict=True))), [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
