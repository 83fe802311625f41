"""The kept index against searches that read every text, and its changes and versions."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import search, text_index
from pagestrata.operators.text_index import TextIndex
from pagestrata.sources import versions
from pagestrata.sources.tables import new_path

WORDS = "alpha alphabet beta beta-max Éte ete zürich gamma delta re thin thin-re rest THIN red 東京 x1 1x".split()
WEIGHTS = {"title": 2, "body": 1}


def docs_of(rnd, n, first=0):
    text = lambda k: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, k)))
    return [(i, text(4) if rnd.random() < 0.9 else None, text(30)) for i in range(first, first + n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, body string")


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


def same(spark, index, rows):
    docs = frame(spark, rows)
    for text in ("alp", "be re", "thin-re", "thin-re alpha", "beta-max-thin ete", "ete", "zuri 東", "nowhere", "x1"):
        assert scores(index.search(text, WEIGHTS)) == scores(search.search(docs, text, WEIGHTS)), text
    assert index.search("  ").count() == 0 and index.search('"-(').count() == 0
    assert {r.id for r in index.search("alp", {"title": 1}).collect()} == {r.id for r in search.search(docs, "alp", {"title": 1}).collect()}


def test_index_equals_reading_every_text(spark):
    rows = docs_of(random.Random(1), 80)
    index = TextIndex.build(frame(spark, rows), new_path(spark), ["id"], ["title", "body"])
    same(spark, index, rows)
    same(spark, TextIndex(spark, index.path), rows)
    terms = {r.term: (r.n_docs, r.n_hits) for r in index.terms(["body"]).collect()}
    assert terms == {r.term: (r.n_docs, r.n_hits) for r in search.postings(frame(spark, rows), "id", "body").collect()}


def test_changes_write_deltas_and_old_readers_keep_their_version(spark):
    rnd = random.Random(2)
    rows = {r[0]: r for r in docs_of(rnd, 60)}
    index = TextIndex.build(frame(spark, list(rows.values())), new_path(spark), ["id"], ["title", "body"])
    old, before = TextIndex(spark, index.path), dict(rows)
    base = index.content["generations"][0]
    added = docs_of(rnd, 20, 50)
    index.add(frame(spark, added))
    rows |= {r[0]: r for r in added}
    index.remove(frame(spark, [(3, "", ""), (55, "", ""), (999, "", ""), (None, "", "")]))
    rows.pop(3), rows.pop(55)
    again = [(3, "alpha beta", "thin re")]
    index.add(frame(spark, again))
    rows[3] = again[0]
    same(spark, index, list(rows.values()))
    same(spark, old, list(before.values()))
    assert index.content["generations"][0] == base and len(index.content["generations"]) == 4
    index.compact()
    same(spark, index, list(rows.values()))
    assert len(index.content["generations"]) == 1
    index.vacuum()
    same(spark, index, list(rows.values()))
    with pytest.raises(versions.VersionConflict):
        old.remove(frame(spark, [(1, "", "")]))


def test_failed_change_leaves_the_version_before(spark):
    rows = docs_of(random.Random(3), 20)
    index = TextIndex.build(frame(spark, rows), new_path(spark), ["id"], ["title", "body"])
    bad = frame(spark, docs_of(random.Random(4), 5, 100)).withColumn("title", F.when(F.col("id") > 102, F.raise_error(F.lit("torn"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="torn"):
        index.add(bad)
    same(spark, TextIndex(spark, index.path), rows)


def test_keys_of_two_columns_and_rows_without_a_key(spark):
    rows = spark.createDataFrame([("t", 1, "alpha"), ("t", 2, "alpha beta"), (None, 3, "alpha"), ("u", 1, None)], "thread string, n int, body string")
    index = TextIndex.build(rows, new_path(spark), ["thread", "n"], ["body"])
    assert {(r.thread, r.n) for r in index.search("alph").collect()} == {("t", 1), ("t", 2)}
    assert index._live("lengths").count() == 3


def test_empty_index(spark):
    index = TextIndex.build(frame(spark, []), new_path(spark), ["id"], ["title", "body"])
    assert index.search("a").count() == 0 and index.terms().count() == 0
    index.add(frame(spark, [(1, "alpha", "beta")]))
    assert [r.id for r in index.search("alp be").collect()] == [1]


def test_prefix_ranges_reach_the_scan(spark):
    index = TextIndex.build(frame(spark, docs_of(random.Random(5), 50)), new_path(spark), ["id"], ["title", "body"])
    plan = index.matches("alp")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,alp)" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_texts_are_split_once_and_dealt_to_tasks(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        runs.add(1)
        return text

    rows = docs_of(random.Random(6), 40)
    docs = frame(spark, rows).coalesce(1)
    index = TextIndex.build(docs.withColumn("body", seen("body")), new_path(spark), ["id"], ["title", "body"])
    assert runs.value == 40  # sampled ranges and lengths read what was split
    same(spark, index, rows)


def test_grouping_of_batches_and_a_key_twice(spark, monkeypatch):
    import pyarrow as pa

    rnd = random.Random(7)
    for limit in (1, 5, 1 << 20):
        monkeypatch.setattr(text_index, "BATCH_TOKENS", limit)
        lists = [[rnd.choice("abc") for _ in range(rnd.randrange(5))] for _ in range(20)]
        batch = pa.RecordBatch.from_pydict({"id": list(range(22)), "column": ["body"] * 22, "tokens": pa.array([[], *lists, []], pa.list_(pa.string()))}).slice(1)
        found = sorted((r["id"], r["term"] or "", r["tf"], r["positions"]) for b in text_index.by_term(iter([batch])) for r in b.to_pylist())
        plain = [(i, t, ts.count(t), [k for k, u in enumerate(ts) if u == t]) for i, ts in enumerate([*lists, []], 1) for t in (sorted(set(ts)) or [""])]
        assert found == [(i, t, n, at) if t else (i, "", 0, []) for i, t, n, at in plain]
    index = TextIndex.build(frame(spark, [(1, None, "alpha beta"), (1, "t", "gamma alpha"), (2, None, None)]), new_path(spark), ["id"], ["title", "body"])
    assert {r.term: (r.n_docs, r.n_hits) for r in index.terms().collect()} == {"alpha": (1, 2), "beta": (1, 1), "gamma": (1, 1), "t": (1, 1)}
    assert [tuple(r) for r in index._live("lengths").orderBy("id").collect()] == [(1, 1, 4), (2, 0, 0)]
