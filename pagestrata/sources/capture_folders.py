"""Folders of captures as a data source: line files that are still being appended to, read in batch and as a stream.

A root holds a folder per capture, whose name is the capture's id; in it lie its journal, its
sidecar and whatever else has lines. Spark's own stream over files takes a file once, whereas a
journal grows, so the source keeps offsets in bytes by capture.

A range of bytes yields the lines whose line feed lies in it, and seeks back to where its first
line begins. Ranges thus split a journal of any length over tasks, and a stream goes on where it
stopped without looking into files on the driver. What follows the last line feed is torn: a batch shows it as such,
a stream waits for its end.

Filters archive_id = ... and archive_id IN (...) are pushed: only the folders asked for are opened,
and the root isn't listed. Text is parsed in Spark (`records`, `sidecars`), not here.

Options: path, the root, of a file system that pyarrow knows; file, the file's name in each folder; whole, "true" for one row a
file; splitSize, bytes a range, and a task where there are few; maxLine, the longest line in bytes.

Defined cases: folders without the file, files that vanish meanwhile and hidden folders (a dot or an underscore first) give no rows; an empty file gives
none either, or one empty row where whole is set; a line (or a whole file) over maxLine is a torn row with null line and null offset; bytes
that are no UTF-8 become U+FFFD; a carriage return before a line feed is dropped. A stream reads a file that became shorter from its start, as it is
another file; one replaced by another of the same length or longer can't be told from one that grew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT = "capture_folders"
SCHEMA = "archive_id string, offset long, line string, torn boolean"
BATCH = pa.schema([("archive_id", pa.string()), ("offset", pa.int64()), ("line", pa.string()), ("torn", pa.bool_())])
CHUNK, OPEN_COST, BATCH_BYTES = 1 << 20, 1 << 20, 8 << 20
SPLIT_SIZE, MAX_LINE = 128 << 20, 16 << 20
FEW_TASKS = 200

# Names of the files, the version of sidecars and the fields that a usable sidecar has.
JOURNAL, SIDECAR = "checkpoint.jsonl", "checkpoint-meta.json"
SIDECAR_VERSION = 1
SIDECAR_VERSION_FIELD, SIDECAR_TEXTS, SIDECAR_OBJECT = "checkpointVersion", ("archiveId", "outputPath", "startUrl"), "scope"


@dataclass
class Range(InputPartition):
    """Byte ranges of files for one task: (name, start, end, whether end is the file's)."""

    parts: list[tuple[str, int, int, bool]]


class CaptureFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options)


class Folders:
    """What readers and the writer know of a root."""

    def __init__(self, options):
        self.root = options["path"]
        self.file = options.get("file", JOURNAL)
        self.whole = options.get("whole", "false").lower() == "true"
        self.split = int(options.get("splitSize", SPLIT_SIZE))
        self.limit = int(options.get("maxLine", MAX_LINE))

    def opened(self) -> tuple[files.FileSystem, str]:
        system, base = files.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    def sizes(self, asked: set[str] | None = None) -> dict[str, int]:
        """The file's size by capture, of the captures that have it."""
        system, base = self.opened()
        if asked is None:
            listed = system.get_file_info(files.FileSelector(base, allow_not_found=True))
            asked = {i.base_name for i in listed if i.type == files.FileType.Directory}
        names = sorted(n for n in asked if n and n[0] not in "._" and "/" not in n)
        found = system.get_file_info([f"{base}/{n}/{self.file}" for n in names])
        return {n: i.size for n, i in zip(names, found) if i.type == files.FileType.File}

    def packed(self, ranges: list[tuple[str, int, int]]) -> list[Range]:
        """Ranges cut to the split size, small ones together in one task.

        Over FEW_TASKS tasks, a task takes more ranges, up to SPLIT_SIZE, so that a small split size doesn't make tasks in proportion to the bytes.
        """
        out: list[Range] = []
        room, open_cost = 0, min(OPEN_COST, self.split // 16)
        most = max(self.split, min(SPLIT_SIZE, sum(end - start + open_cost for _, start, end in ranges) // FEW_TASKS))
        for name, start, end in ranges:
            step = max(end - start, 1) if self.whole else self.split
            for a in range(start, max(end, start + 1), step):
                b = min(a + step, end)
                cost = b - a + open_cost
                if not out or cost > room:
                    out.append(Range([]))
                    room = most + open_cost
                out[-1].parts.append((name, a, b, b == end))
                room -= cost
        return out

    def batches(self, task: Range | None, torn: bool) -> Iterator[pa.RecordBatch]:
        if task is None:  # Spark plans one such task where there are none
            return
        system, base = self.opened()
        rows, size = [], 0
        for name, start, end, last in task.parts:
            try:
                with system.open_input_file(f"{base}/{name}/{self.file}") as f:
                    found = self.content(f, end) if self.whole else lines(f, start, end, torn and last, self.limit)
                    for offset, line, is_torn in found:
                        rows.append((name, offset, None if line is None else line.decode("utf-8", "replace"), is_torn))
                        size += 64 + len(line or b"")
                        if size >= BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
            except FileNotFoundError:
                continue
        if rows:
            yield batch(rows)

    def content(self, f, size: int) -> Iterator[tuple[int | None, bytes | None, bool]]:
        yield (0, f.read(), False) if size <= self.limit else (None, None, True)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), BATCH.types)], schema=BATCH)


def line_start(f, at: int, limit: int) -> int | None:
    """Where the line that holds byte at begins; None if that is more than limit bytes before."""
    end = at
    while end > 0:
        begin = max(end - (64 << 10), 0)
        f.seek(begin)
        found = f.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
        if at - end > limit:
            return None
    return 0


def lines(f, start: int, end: int, torn: bool, limit: int) -> Iterator[tuple[int | None, bytes | None, bool]]:
    """(offset, line, torn) of the lines whose line feed lies in [start, end), and of the rest after the last one if torn is set."""
    at = line_start(f, start, limit)
    held, n_held, position = [], 0, start
    if at is None:
        n_held = limit + 1  # too long already
    elif at < start:
        f.seek(at)
        held, n_held = [f.read(start - at)], start - at
    f.seek(start)
    while position < end:
        chunk = f.read(min(CHUNK, end - position))
        if not chunk:
            break
        *ended, rest = chunk.split(b"\n")
        for piece in ended:
            position += len(piece) + 1
            held.append(piece)
            yield (at, b"".join(held).removesuffix(b"\r"), False) if n_held + len(piece) <= limit else (None, None, True)
            at, held, n_held = position, [], 0
        position += len(rest)
        n_held += len(rest)
        held = [*held, rest] if n_held <= limit else []
    if torn and n_held:
        yield (at, b"".join(held), True) if n_held <= limit else (None, None, True)


class FolderReader(Folders, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("archive_id",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.asked = named if self.asked is None else self.asked & named
            else:
                yield f

    def partitions(self) -> list[Range]:
        asked = None if self.asked is None else {n for n in self.asked if n is not None}
        return self.packed([(n, 0, size) for n, size in self.sizes(asked).items() if size or self.whole])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.batches(partition, torn=True)


class FolderStream(Folders, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        if self.whole:
            raise ValueError("whole files are read in batch only")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        begins = {n: (start.get(n, 0) if start.get(n, 0) <= size else 0) for n, size in end.items()}
        return self.packed([(n, begins[n], size) for n, size in end.items() if size > begins[n]])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.batches(partition, torn=False)


class FolderWriter(Folders, DataSourceArrowWriter):
    """Writes rows (archive_id, line) as files; a capture's rows come to one task, one after another.

    A file appears under its name when it is whole, and takes the place of an older one. A task that is run again writes the
    same file again, so a lost executor leaves neither half a file nor lines twice.
    """

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = self.opened()
        done, name, out, hidden = set(), None, None, ""
        feed = "" if self.whole else "\n"

        def close() -> None:
            if out is not None:
                out.close()
                system.move(hidden, f"{base}/{name}/{self.file}")

        for each in iterator:
            rows = zip(each.column("archive_id").to_pylist(), each.column("line").to_pylist())
            for capture, found in groupby(rows, key=itemgetter(0)):
                if out is None or capture != name:
                    close()
                    name, out = capture, None
                    if not name or name in done or "/" in name or name[0] in "._":
                        raise ValueError(f"rows of captures must come together, under names that can be folders: {name!r}")
                    done.add(name)
                    system.create_dir(f"{base}/{name}", recursive=True)
                    hidden = f"{base}/{name}/.{self.file}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(hidden)
                out.write("".join(f"{line}{feed}" for _, line in found).encode())
        close()
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


def registered(spark: SparkSession) -> SparkSession:
    """spark with the source, and with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureFolders)
    return spark


def write(rows: DataFrame, path: str, order: list[str] | None = None, **options: str) -> None:
    """Rows (archive_id string, line string and columns to order by) to files by capture; one file is written by one task, row by row.

    Null lines are empty ones; a line feed inside a line ends it. Ids that are null or can't be folder names are refused.
    """
    registered(rows.sparkSession)
    dealt = rows.withColumn("line", F.coalesce("line", F.lit(""))).repartition("archive_id").sortWithinPartitions("archive_id", *(order or []))
    dealt.select("archive_id", "line").write.format(FORMAT).mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return registered(spark).read.format(FORMAT).options(**options).load(path)


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return registered(spark).readStream.format(FORMAT).options(**options).load(path)


def records(rows: DataFrame, fields: str) -> DataFrame:
    """Journal records: archive_id, offset, the fields (a DDL string that has t) and malformed, true for lines that are no record.

    Torn lines are malformed unless they are whole records that only lack their line feed; blank lines are left out. Fields of malformed lines are null.
    """
    parsed = F.from_json("line", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    each = rows.where(F.col("line").isNull() | (F.trim("line") != "")).select("archive_id", "offset", parsed.alias("_r"))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | F.col("_r.t").isNull()
    names = [c for c in each.select("_r.*").columns if c != "_bad"]
    return each.select("archive_id", "offset", *[F.when(~bad, F.col(f"_r.{c}")).alias(c) for c in names], bad.alias("malformed"))


def sidecars(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """(archive_id, version, start_url, output_path, usable): a row per sidecar; usable ones have the version and all fields, of their types.

    ids opens the folders of these captures only.
    """
    rows = read(spark, path, file=SIDECAR, whole="true")
    if ids is not None:
        rows = rows.where(F.col("archive_id").isin(*ids))
    value = lambda key, t: F.try_variant_get("_v", f"$.{key}", t)
    kind = lambda key: F.coalesce(F.schema_of_variant(value(key, "variant")), F.lit("VOID"))
    text = {k: F.when(kind(k) == "STRING", value(k, "string")) for k in SIDECAR_TEXTS}
    version = F.when(kind(SIDECAR_VERSION_FIELD) != "STRING", value(SIDECAR_VERSION_FIELD, "int"))
    usable = (F.coalesce(version, F.lit(-1)) == SIDECAR_VERSION) & kind(SIDECAR_OBJECT).startswith("OBJECT")
    for t in text.values():
        usable = usable & t.isNotNull()
    parsed = rows.select("archive_id", F.try_parse_json("line").alias("_v"))
    return parsed.select("archive_id", version.alias("version"), text["startUrl"].alias("start_url"), text["outputPath"].alias("output_path"), usable.alias("usable"))
