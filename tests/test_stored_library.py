"""Kept tables and the library on them: what a change touches, versions, schema steps and imports."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import stored_library
from pagestrata.operators.stored_library import StoredLibrary
from pagestrata.sources import keyed_table, versions
from pagestrata.sources.keyed_table import KeyedTable
from pagestrata.sources.tables import new_path

SCHEMA = "k long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(table):
    return {r.k: r.v for r in table.read().collect()}


def test_table_equals_a_dictionary(spark):
    rnd = random.Random(1)
    table, plain = KeyedTable.create(spark, new_path(spark), SCHEMA, ["k"], buckets=4), {}
    for step in range(12):
        rows = {rnd.choice([None, *range(20)]): f"{step}.{i}" for i in range(rnd.randint(0, 6))}
        if step % 4 == 3:
            table.drop(frame(spark, list(rows.items())))
            for k in rows:
                plain.pop(k, None)
        else:
            table.put(frame(spark, list(rows.items())))
            plain |= rows
        if step % 3 == 2:
            assert held(table) == plain == held(KeyedTable(spark, table.path))
    assert max(len(table.files(b)) for b in range(4)) <= keyed_table.MOST_CHANGES
    wanted = frame(spark, [(3, ""), (4, ""), (99, "")])
    assert {r.k: r.v for r in table.lookup(wanted).collect()} == {k: v for k, v in plain.items() if k in (3, 4)}


def test_untouched_buckets_keep_their_files_and_readers_their_version(spark):
    table = KeyedTable.create(spark, new_path(spark), SCHEMA, ["k"], buckets=8)
    table.put(frame(spark, [(i, "a") for i in range(200)]))
    before, reader = {b: list(table.files(b)) for b in range(8)}, KeyedTable(spark, table.path)
    table.put(frame(spark, [(7, "b")]))
    changed = [b for b in range(8) if table.files(b) != before[b]]
    assert len(changed) == 1 and table.files(changed[0])[:-1] == before[changed[0]]
    assert held(table)[7] == "b" and held(reader)[7] == "a"
    with pytest.raises(versions.VersionConflict):
        reader.put(frame(spark, [(8, "c")]))


def test_failed_change_leaves_the_table(spark):
    table = KeyedTable.create(spark, new_path(spark), SCHEMA, ["k"])
    table.put(frame(spark, [(1, "a")]))
    with pytest.raises(Exception, match="torn"):
        table.put(frame(spark, [(1, "b"), (2, "b")]).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("torn"))).otherwise(F.col("v"))))
    assert held(KeyedTable(spark, table.path)) == {1: "a"}


def test_schema_steps_run_in_order_and_once(spark):
    library = StoredLibrary.create(spark, new_path(spark), version=1)
    library.insert(spark.createDataFrame([("1", "Before")], "id string, title string"))
    assert "text_sha256" not in library.rows().columns
    assert library.migrate(1) == 1 and "text_sha256" not in library.rows().columns
    assert library.migrate() == 2
    version = library.table.version
    assert library.migrate() == 2 and library.table.version == version
    row = library.rows().first()
    assert (row.title, row.mhtml_sha256, row.screenshot_sha256, row.text_sha256) == ("Before", None, None, None)
    assert StoredLibrary(spark, library.path).schema_version == 2
    assert StoredLibrary.create(spark, new_path(spark)).schema_version == 2


def test_changes_and_deletes(spark):
    library = StoredLibrary.create(spark, new_path(spark))
    library.insert(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string"))
    library.insert(spark.createDataFrame([("1", "again"), ("3", "c")], "id string, title string"))
    library.change(spark.createDataFrame([("1", 1, "title", "x"), ("1", 2, "title", "y"), ("2", 1, "delete", "1"), ("9", 1, "title", "z"), ("3", 5, "size", "12")], "id string, seq long, op string, value string"))
    library.change(spark.createDataFrame([("2", 9, "title", "late")], "id string, seq long, op string, value string"))
    assert {(r.id, r.title, r.size_bytes, r.deleted) for r in library.rows().collect()} == {("1", "y", 0, False), ("2", "late", 0, True), ("3", "c", 12, False)}
    assert {r.id for r in library.active().collect()} == {"1", "3"}
    library.insert(spark.createDataFrame([("2", "back")], "id string, title string"))
    assert library.active().where("id = '2'").count() == 0


def entry(**more):
    whole = {f: "x" for f in stored_library.STRINGS} | {f: None for f in stored_library.NULLABLE_STRINGS} | {f: 1 for f in stored_library.NUMBERS} | {f: False for f in stored_library.BOOLEANS}
    return whole | {"status": "success", "warnings": [], "tags": ["a"]} | more


def test_every_field_of_an_entry_is_checked(spark):
    good = [entry(), entry(tags=[]), entry(warnings=[{"code": "x"}, 3]), entry(textSha256="a", sizeBytes=1.5), entry(extra=1)]
    bad = [{k: v for k, v in entry().items() if k != f} for f in entry()]
    bad += [entry(**{f: 1}) for f in (*stored_library.STRINGS, *stored_library.NULLABLE_STRINGS, *stored_library.BOOLEANS)]
    bad += [entry(**{f: "1"}) for f in stored_library.NUMBERS] + [entry(**{f: None}) for f in (*stored_library.STRINGS, *stored_library.NUMBERS, *stored_library.BOOLEANS)]
    bad += [entry(status="odd"), entry(tags="a"), entry(tags=["a", 1]), entry(tags=["a", None]), entry(tags=[None]), entry(tags=None), entry(warnings={}), entry(warnings=None)]
    texts = [*map(json.dumps, good), *map(json.dumps, bad), "no json", "[]", "3", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r.ok for r in rows.select("i", stored_library.valid_entry(F.try_parse_json("t")).alias("ok")).orderBy("i").collect()]
    assert found == [True] * len(good) + [False] * (len(texts) - len(good))


def test_import_takes_verified_files(spark):
    uid = lambda n: f"00000000-0000-4000-8000-{n:012d}"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    library = StoredLibrary.create(spark, new_path(spark))
    library.insert(spark.createDataFrame([(uid(1), "known")], "id string, title string"))
    entries = [
        entry(id=uid(1)),
        entry(id=uid(2), title="two", hasText=True, textSha256=sha(b"text"), hasMhtml=True, mhtmlSha256=None),
        entry(id=uid(3), hasText=True, textSha256="wrong", hasScreenshot=True, screenshotSha256=sha(b"shot"), warnings=[{"code": "own"}]),
        entry(id="../x"),
        entry(id=uid(2), title="again"),
    ]
    files = spark.createDataFrame([(uid(2), "text.txt", b"text"), (uid(2), "page.mhtml", b"mail"), (uid(3), "text.txt", b"text")], "id string, name string, content binary")
    outcomes = library.import_entries(spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(entries)], "n long, entry string"), files)
    assert [r.outcome for r in outcomes.orderBy("n").collect()] == ["skipped", "imported", "imported", "failed", "skipped"]
    rows = {r.id: r for r in library.rows().collect()}
    assert rows[uid(1)].title == "known" and len(rows) == 3
    two, three = rows[uid(2)], rows[uid(3)]
    assert (two.title, two.has_text, two.has_mhtml, two.has_screenshot, two.size_bytes, two.text_sha256, json.loads(two.warnings)) == ("two", True, True, False, 8, sha(b"text"), [])
    assert (three.has_text, three.has_screenshot, three.size_bytes, three.text_sha256) == (False, False, 0, None)
    lost = [{"code": "import-content-missing", "message": f"{name} could not be verified during import and was dropped"} for name in ("screenshot.png", "text.txt")]
    assert json.loads(three.warnings) == [{"code": "own"}, *lost]
    assert json.loads(two.tags) == ["a"]
