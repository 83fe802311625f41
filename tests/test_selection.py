"""What captures fetch, library searches, snippets and the limits of requests, on small made-up rows."""

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import html, text, urls
from pagestrata.operators import budget, catalog, crawl, library, search
from pagestrata.sources import journal_log, zips
from pagestrata.sources.tables import new_path

START = "https://f.example/"
LOADED = [
    (1, 0, "https://f.example/a.png", "image"),
    (1, 1, "https://cdn.example/b.png", "image"),
    (1, 2, "https://f.example/c.mp4", "media"),
    (1, 3, "https://f.example/d.pdf", "attachment"),
    (1, 4, "https://f.example/e.pdf", "frame"),
    (1, 5, "https://f.example/d.pdf", "frame"),
    (1, 6, "data:image/png;base64,x", "image"),
    (2, 0, "https://f.example/a.png", "image"),
]


def fetched(spark, **switches):
    rows = spark.createDataFrame(LOADED, "page_id long, pos int, url string, kind string")
    return sorted((r.page_id, r.url.rsplit("/", 1)[1]) for r in crawl.selected_resources(rows, crawl.ResourceScope(START, **switches)).collect())


def test_switches_apply_after_repeats_have_gone(spark):
    every = [(1, "a.png"), (1, "b.png"), (1, "c.mp4"), (1, "d.pdf"), (1, "e.pdf"), (2, "a.png")]
    assert fetched(spark) == every
    assert fetched(spark, media=False) == [x for x in every if x[1] != "c.mp4"]
    assert fetched(spark, documents=False) == [x for x in every if not x[1].endswith("pdf")]
    assert fetched(spark, attachments=False) == [x for x in every if x[1] != "d.pdf"]
    assert fetched(spark, external_images=False) == every
    assert fetched(spark, external_images=False, forum=True) == [x for x in every if x[1] != "b.png"]


@pytest.mark.parametrize("wrong", [{"limit": 0}, {"limit": 501}, {"offset": -1}, {"sort": "best"}, {"status": "lost"}, {"search": "x" * 513}, {"domain": "d" * 256}])
def test_queries_out_of_bounds_are_refused(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        catalog.LibraryQuery(**wrong)


def library_rows(spark):
    rows = [(1, "Red fox", "a.example", "a fox ran", 5), (2, "Blue", "b.example", "no match", 9), (3, "Fox fox", "c.example", "red red fox", 1)]
    named = spark.createDataFrame(rows, "id long, title string, domain string, body string, size_bytes long")
    return named.select("*", F.concat(F.lit("http://"), "domain").alias("final_url"), F.lit("success").alias("status"), F.lit("2024").alias("visited_at"), F.lit(False).alias("deleted"))


def test_a_search_ranks_and_a_blank_one_sorts(spark):
    found = catalog.LibraryQuery(search="red fox", sort="size").page(library_rows(spark)).collect()
    assert {r.id for r in found} == {1, 3} and found[0].score <= found[1].score
    assert {r.id: r.snippet for r in found} == {1: "\x01Red\x02 \x01fox\x02", 3: "\x01red\x02 \x01red\x02 \x01fox\x02"}
    assert [(r.id, r.snippet) for r in catalog.LibraryQuery(search="  ", sort="size").page(library_rows(spark)).collect()] == [(2, None), (1, None), (3, None)]


def snippet(spark, columns, words, width=3):
    row = spark.createDataFrame([tuple(columns)], ", ".join(f"c{i} string" for i in range(len(columns))))
    return row.select(search.best_snippet([F.col(c) for c in row.columns], search.query_words(words), width, ("<", ">"))).first()[0]


def test_snippets_take_the_best_window_of_all_columns(spark):
    assert snippet(spark, ["one fox", "a fox x x x red y fox z"], "red fox") == "…<red> y <fox>…"
    assert snippet(spark, ["fox", "fox"], "fox") == "<fox>"
    assert snippet(spark, ["Füchse a b c", None], "fuchs") == "<Füchse> a b…"
    assert snippet(spark, ["nothing", None], "fox") is None
    assert snippet(spark, ["", ""], "fox") is None


def test_phrases_stay_inside_a_column(spark):
    rows = spark.createDataFrame([(1, "big red", "fox"), (2, "x", "red foxes"), (3, None, "red a fox"), (4, None, "red fox red fox")], "id long, title string, body string")
    assert {r.id for r in search.search(rows, "red-fox", {"title": 1, "body": 1}).collect()} == {2, 4}


def test_limits_of_changes_count_utf16(spark):
    rows = [("x" * 500, ["t"]), ("x" * 501, []), ("\U0001f600" * 250, None), ("\U0001f600" * 251, None), ("t", ["a"] * 33), ("t", ["a" * 64, "b" * 65]), (None, None)]
    found = spark.createDataFrame(rows, "title string, tags array<string>").select(library.change_fault(F.col("title"), F.col("tags"))).collect()
    assert [r[0] for r in found] == [None, "title-too-long", None, "title-too-long", "too-many-tags", "tag-too-long", None]


def test_numbering_goes_on_after_a_resume(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "thread_key string, seq int")
    known = spark.createDataFrame([("a", 4), ("a", None), ("a", 2), ("c", 9)], "thread_key string, page_index int")
    assert {(r.seq, r.page_index) for r in budget.numbered_on(new, known, ["seq"]).collect()} == {(1, 5), (2, 6), (3, 1)}


def test_logs_keep_whole_urls_for_diagnosis_only(spark):
    rows = spark.createDataFrame([("2024", "info", "m", "https://h.example:8443/p?q=1"), ("2024", "warn", "m", "nothing")], "ts string, level string, message string, url string")
    for diagnostic, wanted in ((False, {"https://h.example:8443", "[unparsable-url]"}), (True, {"https://h.example:8443/p?q=1", "nothing"})):
        path = new_path(spark)
        journal_log.log(rows, path, diagnostic)
        assert {r.url for r in journal_log.read_log(spark, path, "ts string, level string, message string, url string").collect()} == wanted


def test_file_names_take_any_suffix(spark):
    row = spark.createDataFrame([("A/B", "h.example"), ("", "h.example")], "t string, h string")
    assert [r[0] for r in row.select(text.archive_filename(F.col("t"), F.col("h"), ".zip")).collect()] == ["A-B.zip", "h.example.zip"]
    assert row.select(urls.is_media(F.lit("https://h.example/x.MP4"))).first()[0]


def test_a_full_crawl_looks_at_no_more_links(spark):
    rows = [(1, "drop", "x"), (2, "enqueue", "a"), (3, "enqueue", "a"), (4, "enqueue", "known"), (5, "skipped-trap", "t"), (6, "enqueue", "b"), (7, "skipped-trap", "u"), (8, "enqueue", "c")]
    links = spark.createDataFrame(rows, "seq int, decision string, url string").withColumn("url", F.concat(F.lit("https://h.example/"), "url"))
    known = spark.createDataFrame([("https://h.example/known",)], "norm string")
    seen = lambda bound: sorted(r.seq for r in crawl.until_full(links, known, ["seq"], bound).collect())
    assert seen(1) == []
    assert seen(2) == [1, 2]
    assert seen(3) == [1, 2, 3, 4, 5, 6]
    assert seen(9) == [r[0] for r in rows]


def test_page_text_is_the_body_without_typed_words(spark):
    page = "<html><head><title>T</title></head><body><header>H</header><textarea name=x>typed</textarea><script>s</script>b</body></html>"
    assert spark.range(1).select(html.text(F.lit(page))).first()[0] == "H b"


def test_zips_hold_what_shrinks_far_and_tell_damaged_entries(spark):
    word = b"same " * 600_000
    files = spark.createDataFrame([("long", word), ("short", b"x")], "path string, content binary").coalesce(1)
    made = zips.zipped(files).collect()
    rows = [("whole", made[0]["content"]), ("damaged", made[0]["content"].replace(b"same same", b"lame same", 1))]
    found = {(r.zip, r.path): (r.error, bytes(r.content or b"")) for r in zips.entries(spark.createDataFrame(rows, "zip string, content binary")).collect()}
    assert found == {("whole", "long"): (None, word), ("whole", "short"): (None, b"x"), ("damaged", "long"): ("unreadable-entry", b""), ("damaged", "short"): (None, b"x")}
