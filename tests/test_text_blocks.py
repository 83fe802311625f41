"""Blocks of postings: words as search.tokens gives them, lists of bounded length, one row for many postings."""

import random

from pyspark.sql import functions as F

from pagestrata.operators import search, text_index
from pagestrata.operators.text_index import TextIndex
from pagestrata.sources import versions
from pagestrata.sources.tables import new_path

ODD = ["", " ", None, "ABC déf-g9", "İstanbul ẞ ﬁ", "áb ć", "東京x1,２３ a", "x" * 50, "-a-", "a\x00b c d", "😀 k😀k", "ÄÖ", "z٣z", "é"]


def test_words_are_those_of_search(spark):
    rnd = random.Random(1)
    letters = "aZ0 -_é́İß東😀 .\n"
    texts = [*ODD, *["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = df.select(search.tokens(F.col("text")).alias("t"), text_index.plain_words(F.col("text")).alias("w")).toArrow().combine_chunks()
    words, wanted = rows["w"].chunk(0), rows["t"].to_pylist()
    assert text_index.cut_words(words).to_pylist() == wanted
    assert text_index.cut_words(words.slice(3, 40)).to_pylist() == wanted[3:43]
    assert text_index.cut_words(words.slice(0, 1)).to_pylist() == [[]]


def test_postings_are_kept_as_blocks_of_bounded_length(spark, monkeypatch):
    docs = spark.range(2000).select("id", F.concat(F.lit("same again same w"), (F.col("id") % 3).cast("string")).alias("body")).coalesce(1)
    index = TextIndex.build(docs, new_path(spark), ["id"], ["body"])
    for _ in range(2):
        kept = index._generations("postings")[0].where("term is not null")
        assert kept.count() < 100  # 6,000 postings were as many rows
        assert kept.agg(F.max(F.size("tf"))).first()[0] <= text_index.BLOCK
        assert {(r.term, r.n_docs, r.n_hits) for r in index.terms().collect()} == {("same", 2000, 4000), ("again", 2000, 2000), ("w0", 667, 667), ("w1", 667, 667), ("w2", 666, 666)}
        assert index.search("again-same-w1").count() == 667 and index._live("postings").columns == ["term", "column", "id", "tf"]
        index.compact()


def test_removed_keys_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    docs = spark.range(300).select("id", F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("body"))
    found = []
    for most in (text_index.BROADCAST_KEYS, 10):
        monkeypatch.setattr(text_index, "BROADCAST_KEYS", most)
        index = TextIndex.build(docs, new_path(spark), ["id"], ["body"])
        index.add(docs.where("id % 4 = 0").withColumn("body", F.lit("new")))
        index.remove(docs.where("id % 10 = 0"))
        plan = index._live("postings")._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (most > 10)
        before = sorted(map(tuple, index.terms().collect()))
        index.compact()
        found.append((before, sorted(map(tuple, index.terms().collect()))))
    assert found[0] == found[1] and found[0][0] == found[0][1] and ("new", 60, 60) in found[0][0]


def test_an_index_of_another_layout_is_refused(spark):
    import pytest

    path = new_path(spark)
    versions.publish(spark, path, 1, {"key": [["id", "bigint"]], "columns": ["body"], "generations": []})
    with pytest.raises(ValueError, match="layout"):
        TextIndex(spark, path)


def test_words_are_folded_once_each_and_never_by_the_session(spark):
    # letters that lose an accent or only marks become the same word or none, in one text and over several
    texts = ["Éte éte ete ́ ́̂-a", "́", "ete «été»—x…", None, "ÉTÉ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    plain = df.select(text_index.plain_words(F.col("text")).alias("w"))
    assert "translate" not in plain._jdf.queryExecution().optimizedPlan().toString().lower()
    words = text_index.cut_words(plain.toArrow().combine_chunks()["w"].chunk(0))
    assert words.to_pylist() == [["ete", "ete", "ete", "a"], [], ["ete", "ete", "x"], [], ["ete"]] and words.to_pylist() == [r[0] for r in df.select(search.tokens(F.col("text"))).collect()]
    assert sorted(words.values.dictionary.to_pylist()) == ["", "a", "ete", "x"]


def test_positions_are_one_list_a_block_and_postings_are_read_once_a_search(spark):
    docs = spark.range(700).select("id", F.concat(F.lit("same "), F.repeat(F.lit("again same "), (F.col("id") % 3).cast("int")), F.lit("é")).alias("body")).coalesce(1)
    index = TextIndex.build(docs, new_path(spark), ["id"], ["body"])
    for _ in range(2):
        assert dict(index._generations("postings")[0].dtypes)["positions"] == "array<int>"
        kept = {(r.term, r.id): r.positions for r in index._live("postings", positions=True).collect()}
        assert kept == {(w, i): [k for k, t in enumerate(["same", *["again", "same"] * (i % 3), "e"]) if t == w] for i in range(700) for w in (["same", "again", "e"] if i % 3 else ["same", "e"])}
        assert index.search("again-same-e").count() == 466
        found = index.search("sa e")
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet [term") == 1 and "ReusedExchange" in plan
        index.compact()


def test_dropped_elements_are_those_of_the_sql_pattern(spark):
    from pagestrata.functions import html

    parts = ["<script>", "</script>", "<STYLE a='b'>", "</style>", "<head>", "<header>", "</head>", "<noscript", ">", "</NOSCRIPT>", "<textarea x>", "</textarea>", "<", "a <b", " \n", "<scripts>", "text"]
    rnd = random.Random(3)
    pages = spark.createDataFrame([("".join(rnd.choice(parts) for _ in range(rnd.randrange(25))),) for _ in range(3000)], "html string")
    of = lambda p: F.regexp_replace("html", p, " ")
    assert html._DROPPED_FAST != html.DROPPED and pages.where(of(html._DROPPED_FAST) != of(html.DROPPED)).isEmpty()
