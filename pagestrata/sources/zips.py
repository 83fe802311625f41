"""Zip containers as rows: files to zips of bounded size, and zips to verified entries."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Limits on what a zip may hold.
MAX_ENTRY_BYTES, MAX_TOTAL_BYTES, MAX_ENTRIES = 256 << 20, 4 << 30, 200_000
MAX_RATIO, RATIO_FROM_BYTES = 200, 1 << 20
ZIP_BYTES = 16 << 20
ENTRIES = pa.schema([("zip", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def zipped(files: DataFrame, limit: int = ZIP_BYTES) -> DataFrame:
    """files (path, content binary) as zips (content, n_entries), each closed once limit bytes are in; null content is empty.

    Every task fills its own zips, so nothing is shuffled. Content that would shrink so far that readers refuse it is stored as it is.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()], pa.binary()), pa.array([len(out.namelist())], pa.int64())], ["content", "n_entries"])

        out, held = None, 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if out is None:
                    buffer, held = io.BytesIO(), 0
                    out = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                data = content.as_py() or b""
                out.writestr(path.as_py(), data, zipfile.ZIP_STORED if shrinks_too_far(data) else None)
                held += len(data)
                if held >= limit:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return files.select("path", "content").mapInArrow(write, "content binary, n_entries long")


def shrinks_too_far(data: bytes) -> bool:
    # a zlib stream has six bytes around what a zip's entry holds
    return len(data) > RATIO_FROM_BYTES and len(data) > MAX_RATIO * (len(zlib.compress(data)) - 6)


def safe_name(name: str) -> bool:
    """A relative path that stays inside its container."""
    plain = name.replace("\\", "/")
    return bool(plain) and "\0" not in plain and not plain.startswith("/") and plain[1:2] != ":" and posixpath.normpath(plain).split("/")[0] != ".."


def refusal(infos: list[zipfile.ZipInfo]) -> str | None:
    """Why a zip with these entries is not read at all."""
    if len(infos) > MAX_ENTRIES:
        return "too-many-entries"
    if any(not safe_name(i.filename) for i in infos):
        return "unsafe-path"
    if any(i.file_size > MAX_ENTRY_BYTES for i in infos):
        return "entry-too-large"
    if any(i.file_size > RATIO_FROM_BYTES and i.file_size > MAX_RATIO * max(1, i.compress_size) for i in infos):
        return "compression-bomb"
    return "archive-too-large" if sum(i.file_size for i in infos) > MAX_TOTAL_BYTES else None


def entries(zips: DataFrame) -> DataFrame:
    """(zip, path, content, error) of zips (zip, content): one row per entry, with an error if it is damaged or locked, or one row with an error for a zip that is refused."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, ENTRIES.types, strict=True)], schema=ENTRIES)

        for batch in batches:
            for name, content in zip(batch.column("zip"), batch.column("content"), strict=True):
                own = name.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as opened:
                        infos = [i for i in opened.infolist() if not i.is_dir()]
                        error = refusal(infos)
                        if error:
                            yield row(own, None, None, error)
                            continue
                        for info in infos:
                            try:
                                with opened.open(info) as entry:
                                    data, fault = entry.read(MAX_ENTRY_BYTES + 1), None
                            except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError):
                                data, fault = None, "unreadable-entry"
                            yield row(own, info.filename, data, fault)
                except zipfile.BadZipFile:
                    yield row(own, None, None, "not-a-zip")

    return zips.select("zip", "content").mapInArrow(read, "zip string, path string, content binary, error string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """entries() of zip files at a path or pattern that Spark can read."""
    return entries(spark.read.format("binaryFile").load(path).selectExpr("path as zip", "content"))
