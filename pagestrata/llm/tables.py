"""Reading the given tables, cutting lineage, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="pagestrata-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths of tables that the innermost scratch() deletes when it ends.
_OPEN: ContextVar[list[list[str]]] = ContextVar("open", default=[])


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle(df: DataFrame, outside: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread and not a
    recomputation, and Spark knows the size of what it reads. The table is deleted
    when the scratch() around it ends (outside: the next one outwards), or by Hadoop
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagestrata-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    scopes = _OPEN.get()
    if len(scopes) > outside:
        scopes[-1 - outside].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables settled inside when it ends; gives a settle() whose tables stay."""
    mine: list[str] = []
    token = _OPEN.set([*_OPEN.get(), mine])
    try:
        yield lambda df: settle(df, outside=True)
    finally:
        _OPEN.reset(token)
        for path in mine:
            fs, at = _hadoop(spark, path)
            fs.delete(at, True)


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are within the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df
