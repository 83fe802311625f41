"""Published versions of a folder: a numbered file names the data that makes up each version.

A writer puts new data beside the old, and then publishes a version that names what is to be
read. Readers hold what their version names, so nothing that they read is overwritten, and a
write that fails leaves the version before it. A version that is already there isn't replaced:
of two writers that start from the same version the second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Another writer has published this version."""


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = hadoop(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def read(spark: SparkSession, path: str, number: int) -> dict:
    fs, at = hadoop(spark, f"{path}/versions/{number:010d}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and content of the newest version; (0, {}) where there is none."""
    known = numbers(spark, path)
    return (known[-1], read(spark, path, known[-1])) if known else (0, {})


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    fs, at = hadoop(spark, f"{path}/versions/{number:010d}.json")
    _, part = hadoop(spark, f"{path}/versions/{uuid.uuid4().hex}.part")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)
        raise VersionConflict(f"version {number} of {path} is there already")
