"""The capture journal as JSON lines: an append-only sink, and a source that sets malformed lines apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import urls

RECORD = "archive_id long, seq long, t string, norm string, value double"


def append(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records with malformed: true for lines that are no record, whose other columns are null."""
    lines = spark.read.text(path)
    record = F.from_json("value", f"{RECORD}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(record.alias("r")).select("r.*")
    bad = F.col("_bad").isNotNull() | F.col("archive_id").isNull() | F.col("t").isNull()
    fields = [F.when(~bad, F.col(c)).alias(c) for c in ("archive_id", "seq", "t", "norm", "value")]
    return rows.select(*fields, bad.alias("malformed"))


def log(entries: DataFrame, path: str, diagnostic: bool = False) -> None:
    """Append log entries (ts, level, message, url and others) as JSON lines; URLs lose all but scheme and host unless diagnostic."""
    shown = entries if diagnostic else entries.withColumn("url", urls.redact(F.col("url")))
    append(shown, path)


def read_log(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Log entries with the given fields, as a DDL string; lines that are no entry have nulls."""
    return spark.read.text(path).select(F.from_json("value", fields).alias("r")).select("r.*")
