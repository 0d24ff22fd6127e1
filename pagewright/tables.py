"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder where ``spark.checkpoint.dir`` is unset, for sessions on one machine only.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one on this machine where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = LOCAL_DIR
    return folder.rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle and sort, however small it looks.

    Rows of files repeat each other: a few MB of Parquet or of shuffle blocks, which Spark would broadcast, are some 100 MB of rows in every task,
    and grow with the files.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a later loss of an executor re-reads the table and does not recompute it. The
    table lives until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
