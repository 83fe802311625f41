"""Cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagestrata.sources.versions import hadoop


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors can't share a folder of the driver's machine")
        folder = tempfile.mkdtemp(prefix="pagestrata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """An unused path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/pagestrata-{uuid.uuid4().hex}"
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write df to a new path of the shared folder and read it back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
