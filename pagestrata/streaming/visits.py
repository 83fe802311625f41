"""Structured Streaming forms of the visit and journal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import journal
from pagestrata.sources.tables import new_path


def debounced(visits: DataFrame, gap: str, late: str) -> DataFrame:
    """The last visit of each burst per tab, once the watermark is past the burst's end; a pause equal to gap still belongs to the burst.

    visits: archive_id, seq, norm, ts (timestamp). Visits later than late behind the newest one are dropped.
    """
    bursts = visits.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "archive_id")
    return bursts.agg(F.max_by(F.struct("seq", "norm"), F.struct("ts", "seq")).alias("last")).select("archive_id", "last.seq", "last.norm")


def state(records: DataFrame) -> DataFrame:
    """The folded state of each capture, kept up to date while records arrive in any order."""
    return journal.state(records)


def appended(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, appending to a table in the shared folder, and reads that table."""
    path = new_path(stream.sparkSession)
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def completed(stream: DataFrame) -> DataFrame:
    """As appended(), for aggregates whose rows change: each micro-batch replaces the table."""
    path = new_path(stream.sparkSession)
    run = (
        stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .outputMode("complete")
        .option("checkpointLocation", f"{path}-log")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
