import json
import random
import re

from pyspark.sql import functions as F

from pagestrata.functions.shapes import WHOLE, faults
from pagestrata.operators import requests

MISSING = object()
VALUES = [
    MISSING, None, True, False, 0, 1, 6, 7, 25, 26, 0.5, -1, 1e3, 3.0, 2**53, 1048575, 1048576, 64 * 1024**3 + 1, "", "x", "5", "ask", "success", "custom", "newest", "é" * 255, "😀" * 250, "😀" * 251, "a" * 4097,
    [], [1], ["a"], ["a", None], ["a", 1], ["b" * 255], ["😀" * 128], ["a"] * 100, ["a"] * 101, [["a"]], {}, {"a": "ask"}, {"a": "ask", "b": "no"}, {"a": None}, {"a": 1}, "0123abcd-0123-0123-0123-0123456789AB",
]


def units(text):
    return len(text.encode("utf-16-le")) // 2


def within(n, field):
    return (field.low is None or n >= field.low) and (field.high is None or n <= field.high)


def fits(value, field):
    """The same rules over values of Python's JSON reader."""
    if value is MISSING:
        return field.absent
    if value is None:
        return field.null
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    match field.kind:
        case "number":
            return number and within(value, field)
        case "whole":
            return number and value == int(value) and abs(value) <= WHOLE and within(value, field)
        case "text":
            return isinstance(value, str) and within(units(value), field) and (not field.choices or value in field.choices) and (not field.pattern or bool(re.search(field.pattern, value)))
        case "boolean":
            return isinstance(value, bool)
        case "list":
            return isinstance(value, list)
        case "texts":
            return isinstance(value, list) and len(value) <= (field.most or WHOLE) and all(isinstance(t, str) and units(t) <= (field.longest or WHOLE) for t in value)
        case "choices":
            return isinstance(value, dict) and all(isinstance(t, str) and t in field.choices for t in value.values())
    return isinstance(value, dict)


def test_every_field_against_every_value(spark):
    shapes = requests.REQUESTS | {"entry": requests.ENTRY}
    rng = random.Random(5)
    for kind, shape in shapes.items():
        bodies = [{n: v for n in shape} for v in VALUES] + [{n: rng.choice(VALUES) for n in shape} for _ in range(60)]
        rows = [(i, json.dumps({n: v for n, v in b.items() if v is not MISSING}, ensure_ascii=i % 2 == 0)) for i, b in enumerate(bodies)]
        found = spark.createDataFrame(rows, "i int, body string").select("i", faults(F.col("body"), shape).alias("f")).collect()
        for r in found:
            assert r["f"] == [n for n, v in bodies[r["i"]].items() if not fits(v, shape[n])], (kind, rows[r["i"]])


def test_what_is_no_object_is_a_fault_of_its_own(spark):
    bodies = [None, "", "nul", "null", "5", '"x"', "[]", '{"domain": ', '{"domain": "a", "domain": "b"}', '{"domain": "a", "more": 1}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", requests.request_faults("by-domain", F.col("body")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in rows] == [[""]] * 9 + [[]]
    assert rows[0].__fields__ == ["i", "f"]


def test_entries_with_faults_have_no_fields(spark):
    good = {n: "t" if f.kind == "text" else 1 if f.kind == "number" else f.kind == "boolean" or [] for n, f in requests.ENTRY.items()} | {"status": "success", "tags": ["a", "b"], "warnings": [{"k": 1}, None], "sizeBytes": 12.5}
    bad = good | {"tags": ["a", 2], "hasText": 1}
    rows = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), (None,)], "entry string")
    kept, *lost = requests.manifest_entries(rows).collect()
    assert kept["faults"] == [] and (kept["id"], kept["size"], kept["tags"], kept["has_text"], kept["n_warnings"]) == ("t", 12.5, ["a", "b"], True, 2)
    assert [r["faults"] for r in lost] == [["tags", "hasText"], [""]]
    assert all(r[c] is None for r in lost for c in ("id", "canonical_url", "title", "status", "size", "tags", "has_text", "text_sha256", "n_warnings"))
    assert requests.manifest_entries(rows.limit(0)).count() == 0
