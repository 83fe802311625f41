from pagestrata.operators import search


def test_words_lose_accents(spark):
    docs = spark.createDataFrame([(1, "Été à Zürich"), (2, "ete a zurich"), (3, "été Łódź"), (4, None)], "id int, body string")
    found = lambda words: {r.id for r in search.search(docs, words, {"body": 1}).collect()}
    assert found("été") == found("ETE") == {1, 2, 3}
    assert found("zuri") == {1, 2}
    assert found("łod") == {3} and found("lod") == set()
    assert found("  ") == set()
