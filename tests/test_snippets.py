"""Snippets by phrase against a plain search of all windows."""

import random
import re
import time

from pyspark.sql import functions as F

from pagestrata.operators import results, search


def plain_tokens(word):
    return [t for t in re.split(r"[\W_]+", word.lower()) if t]


def plain_snippet(columns, words, width, marks):
    best = None
    for c, column in enumerate(columns):
        parts = (column or "").split()
        flat = [(t, i) for i, w in enumerate(parts) for t in plain_tokens(w)]
        hits = set()
        for at in range(len(flat)):
            for p, phrase in enumerate(words):
                run = flat[at:at + len(phrase)]
                if len(run) == len(phrase) and [t for t, _ in run[:-1]] == phrase[:-1] and run[-1][0].startswith(phrase[-1]):
                    hits.add((run[0][1], run[-1][1], p))
        for start in sorted({h[0] for h in hits}):
            inside = [h for h in hits if start <= h[0] < start + width and (h[1] < start + width or h[0] == start)]
            n = len({h[2] for h in inside})
            if best is None or n > best[0]:
                out = []
                for k, w in enumerate(parts[start:start + width]):
                    at = start + k
                    held = any(a <= at <= b for a, b, _ in inside)
                    joined = k > 0 and any(a < at <= b for a, b, _ in inside)
                    goes_on = k < width - 1 and any(a < at + 1 <= b for a, b, _ in inside)
                    out.append((marks[0] if held and not joined else "") + w + (marks[1] if held and not goes_on else ""))
                best = (n, ("…" if start else "") + " ".join(out) + ("…" if len(parts) > start + width else ""))
    return best and best[1]


def test_windows_equal_a_search_of_all(spark):
    rng = random.Random(3)
    for query in ("red", "red fox", "red-fox", "red-fo fox-red blue", "fox-fox-fox red", "a-b-c-d-e-f red"):
        words = search.query_words(query)
        pool = ["red", "fox", "red-fox", "Fox_red", "blue", "x", "y", "z", "a-b", "c", "d-e", "f", "--", "foxes", "red,fox,fox,fox"]
        rows = [tuple(" ".join(rng.choices(pool, k=rng.randrange(25))) if rng.random() > 0.1 else None for _ in range(2)) for _ in range(120)]
        for width in (1, 3, 10):
            df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").coalesce(1)
            found = df.select("i", search.best_snippet([F.col("a"), F.col("b")], words, width, ("<", ">")).alias("s")).collect()
            for r in found:
                assert r.s == plain_snippet(rows[r.i], words, width, ("<", ">")), (query, width, rows[r.i])


def test_phrases_are_marked_whole(spark):
    row = spark.createDataFrame([("a red fox and a red, fox or red-fox", "x")], "a string, b string")
    one = lambda q, w=10: row.select(search.best_snippet([F.col("a")], search.query_words(q), w, ("<", ">"))).first()[0]
    assert one("red-fox") == "…<red fox> and a <red, fox> or <red-fox>"
    assert one("red-fox-and fox-and-a") == "…<red fox and a> red, fox or red-fox"
    assert one("red-fox", 1) == "…<red>…"
    assert one("fox-blue") is None


def test_one_long_text_takes_seconds(spark):
    spark.createDataFrame([("red fox " * 150_000, "-".join(["red"] * 100_000))], "a string, b string").createOrReplaceTempView("long_texts")
    began = time.time()
    got = spark.table("long_texts").select(search.best_snippet([F.col("a"), F.col("b")], search.query_words("red-fox fox-red red"), 4, ("<", ">"))).first()[0]
    assert got == "<red fox red fox>…"
    assert time.time() - began < 30


def test_results_show_the_window_with_most_words(spark):
    texts = spark.createDataFrame([(1, "t", "alpha x x x x x x x x x x x x then alpha beta"), (2, "alpha beta", "none of them")], "page_id long, title string, body string")
    pages = texts.select("page_id", "title", F.lit("n").alias("norm"))
    found = {r.page_id: r.snippet for r in results.page_results(texts, pages, "alpha beta").collect()}
    assert found == {1: "…alpha beta", 2: "none of them"}
