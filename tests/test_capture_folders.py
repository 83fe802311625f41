import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from pagestrata.sources import capture_folders as folders

FIELDS = "seq long, t string"


def put(root, name, content: bytes, file=folders.JOURNAL, mode="wb"):
    os.makedirs(f"{root}/{name}", exist_ok=True)
    with open(f"{root}/{name}/{file}", mode) as f:
        f.write(content)


def plain(content: bytes, limit: int):
    """Every line with its offset, and the rest after the last line feed."""
    out, at = [], 0
    *ended, rest = content.split(b"\n")
    for line in ended:
        out.append((at, line.removesuffix(b"\r"), False) if len(line) <= limit else (None, None, True))
        at += len(line) + 1
    if rest:
        out.append((at, rest, True) if len(rest) <= limit else (None, None, True))
    return out


@pytest.mark.parametrize("chunk", [3, 7, 1 << 20])
def test_ranges_split_a_file_anywhere(monkeypatch, chunk):
    monkeypatch.setattr(folders, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(300):
        content = b"".join(rng.choice([b"\n", b"a", b"\r\n", b"word", b"x" * 30, "é".encode()]) for _ in range(rng.randrange(40)))
        cuts = sorted({0, len(content), *[rng.randrange(len(content) + 1) for _ in range(rng.randrange(6))]})
        limit = rng.choice([20, 10_000])
        found = [line for a, b in zip(cuts, cuts[1:]) for line in folders.lines(io.BytesIO(content), a, b, b == len(content), limit)]
        assert found == plain(content, limit), (content, cuts, limit)


def test_a_line_longer_than_its_ranges_is_one_line():
    content = b"a" * 300_000 + b"\nb\n"
    cuts = [*range(0, len(content), 1000), len(content)]
    found = [line for a, b in zip(cuts, cuts[1:]) for line in folders.lines(io.BytesIO(content), a, b, False, 1 << 20)]
    assert [(o, len(x)) for o, x, _ in found] == [(0, 300_000), (300_001, 1)]


def test_filters_open_the_asked_folders_only(tmp_path):
    for n in range(5):
        put(tmp_path, n, b"one\n")
    reader = folders.FolderReader({"path": str(tmp_path)})
    left = [*reader.pushFilters([In(("archive_id",), ("1", "3", "9", None, "..", "a/b")), GreaterThan(("offset",), 2)])]
    assert left == [GreaterThan(("offset",), 2)]
    assert [p[0] for task in reader.partitions() for p in task.parts] == ["1", "3"]
    both = folders.FolderReader({"path": str(tmp_path)})
    assert [*both.pushFilters([EqualTo(("archive_id",), "1"), EqualTo(("archive_id",), "2")])] == [] and both.partitions() == []


def test_small_files_share_tasks_and_long_ones_are_split(tmp_path):
    for n in range(40):
        put(tmp_path, f"s{n}", b"x\n")
    put(tmp_path, "t", b"0123456789" * 1000)
    tasks = folders.FolderReader({"path": str(tmp_path), "splitSize": str(4000)}).partitions()
    assert sorted(p[1:] for t in tasks for p in t.parts if p[0] == "t") == [(0, 4000, False), (4000, 8000, False), (8000, 10000, True)]
    assert len(folders.FolderReader({"path": str(tmp_path)}).partitions()) == 1


def test_batch_defined_cases(spark, tmp_path):
    root = str(tmp_path)
    put(root, "empty", b"")
    put(root, ".hidden", b'{"seq": 1, "t": "page"}\n')
    put(root, "other", b"no journal", file="other.txt")
    put(root, "torn", b'{"seq": 1, "t": "page"}\n\n{"seq": 2, "t": "pa')
    put(root, "whole", b'{"seq": 3, "t": "page"}\r\n{"seq": 4, "t": "page"}')
    put(root, "bad", b'\xff\xfe\n{"seq": "x", "t": 1}\n[1]\n{"seq": 5}\n')
    rows = folders.records(folders.read(spark, root), FIELDS).select("archive_id", "offset", "seq", "t", "malformed").collect()
    assert sorted(map(tuple, rows)) == sorted([
        ("torn", 0, 1, "page", False), ("torn", 25, None, None, True), ("whole", 0, 3, "page", False), ("whole", 25, 4, "page", False),
        ("bad", 0, None, None, True), ("bad", 3, None, None, True), ("bad", 24, None, None, True), ("bad", 28, None, None, True),
    ], key=lambda r: r[:2]), rows
    assert {r["archive_id"] for r in folders.read(spark, root, maxLine="10").where("line is null and torn and offset is null").collect()} == {"torn", "whole", "bad"}
    asked = folders.read(spark, root).where(F.col("archive_id").isin("whole", "none"))
    assert {r["archive_id"] for r in asked.collect()} == {"whole"}
    assert folders.read(spark, root + "/absent").count() == 0


def test_a_stream_follows_growing_journals(spark, tmp_path):
    root, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"

    def arrived():
        rows = folders.stream(spark, root, splitSize="16").drop("torn")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["archive_id"], r["line"]) for r in spark.read.schema("archive_id string, line string").parquet(out).collect())

    put(root, "a", b"a one\na tw")
    put(root, "b", b"b one\n")
    assert arrived() == [("a", "a one"), ("b", "b one")]
    put(root, "a", b"o\na three\na four, which is longer than a range of bytes", mode="ab")
    put(root, "c", b"c one\n")
    assert arrived() == [("a", "a one"), ("a", "a three"), ("a", "a two"), ("b", "b one"), ("c", "c one")]
    assert arrived() == [("a", "a one"), ("a", "a three"), ("a", "a two"), ("b", "b one"), ("c", "c one")]
    put(root, "b", b"new\n")
    put(root, "a", b"\n", mode="ab")
    assert arrived()[2:] == [("a", "a three"), ("a", "a two"), ("b", "b one"), ("b", "new"), ("c", "c one")] and ("a", "a four, which is longer than a range of bytes") in arrived()


def test_written_folders_read_back(spark, tmp_path):
    root = str(tmp_path / "new")
    rows = spark.range(3000).select((F.col("id") % 7).cast("string").alias("archive_id"), F.col("id").alias("seq"), F.concat(F.lit("line "), "id").alias("line"))
    folders.write(rows, root, ["seq"])
    found = folders.read(spark, root, splitSize="512").where("not torn")
    assert found.select("archive_id", "line").exceptAll(rows.select("archive_id", "line")).count() == 0 and found.count() == 3000
    with open(f"{root}/3/{folders.JOURNAL}") as f:
        assert f.read().split("\n") == [*[f"line {n}" for n in range(3, 3000, 7)], ""]
    folders.write(rows.where("seq < 7"), root, ["seq"])
    assert folders.read(spark, root).count() == 7
    assert not [n for d in os.listdir(root) for n in os.listdir(f"{root}/{d}") if n != folders.JOURNAL]
    with pytest.raises(Exception, match="can be folders"):
        folders.write(rows.withColumn("archive_id", F.lit("../x")), root)


def test_sidecars(spark, tmp_path):
    good = {"checkpointVersion": 1, "archiveId": "a", "outputPath": "/o", "startUrl": "https://x.example/", "scope": {"maxPages": 1}}
    cases = {
        "good": json.dumps(good),
        "more": json.dumps(good | {"title": None, "extra": [1]}),
        "version": json.dumps(good | {"checkpointVersion": 2}),
        "version_text": json.dumps(good | {"checkpointVersion": "1"}),
        "no_start": json.dumps({k: v for k, v in good.items() if k != "startUrl"}),
        "null_start": json.dumps(good | {"startUrl": None}),
        "number_path": json.dumps(good | {"outputPath": 5}),
        "scope_list": json.dumps(good | {"scope": []}),
        "scope_null": json.dumps(good | {"scope": None}),
        "list": json.dumps([good]),
        "cut": json.dumps(good)[:40],
        "empty": "",
    }
    for name, text in cases.items():
        put(tmp_path, name, text.encode(), file=folders.SIDECAR)
    rows = {r["archive_id"]: r for r in folders.sidecars(spark, str(tmp_path)).collect()}
    assert rows.keys() == cases.keys()
    assert {n for n, r in rows.items() if r["usable"]} == {"good", "more"}
    assert rows["good"]["start_url"] == "https://x.example/" and rows["version"]["version"] == 2 and rows["cut"]["version"] is None
    assert {r["archive_id"] for r in folders.sidecars(spark, str(tmp_path), ["good", "cut", "gone"]).collect()} == {"good", "cut"}


def test_a_small_split_size_makes_no_tasks_in_proportion(tmp_path):
    reader = folders.FolderReader({"path": str(tmp_path), "splitSize": str(64 << 10)})
    few, many = ([(str(i), 0, 10_000) for i in range(n)] for n in (300, 300_000))
    assert len(reader.packed(few)) == 75 and len(reader.packed(many)) <= 201
    assert [p for task in reader.packed(many) for p in task.parts] == [(n, a, b, True) for n, a, b in many]
    assert max(b - a for task in reader.packed([("x", 0, 1 << 30)]) for _, a, b, _ in task.parts) == 64 << 10
