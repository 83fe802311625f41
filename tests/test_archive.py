from pyspark.sql import functions as F

from pagestrata.functions import posts, urls
from pagestrata.operators import archive, crawl, library, replay, results

RECORD = "archive_id long, seq long, ts timestamp, norm string, t string, sha string, url string, title string, target string, post_id string, kind string"


def journal(spark, rows):
    names = [c.split()[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple({"archive_id": 1, "seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], RECORD)


def test_a_later_asset_replaces_its_sources(spark):
    log = journal(
        spark,
        [
            {"t": "assetUrl", "sha": "a", "url": "early"},
            {"t": "asset", "sha": "a", "url": "u1"},
            {"t": "assetUrl", "sha": "a", "url": "u2"},
            {"t": "asset", "sha": "a", "url": "u3"},
            {"t": "assetUrl", "sha": "a", "url": "u5"},
            {"t": "assetUrl", "sha": "a", "url": "u4"},
            {"t": "assetUrl", "sha": "a", "url": "u5"},
            {"t": "assetUrl", "sha": "a", "url": "u3"},
            {"t": "assetUrl", "sha": "b", "url": "unknown"},
        ],
    )
    assert [(r.sha, r.sources) for r in replay.assets(log).collect()] == [("a", ["u3", "u5", "u4"])]


def test_replay_leaves_a_queue_and_interrupted_pages(spark):
    rows = [{"t": "enq", "norm": n} for n in "abcd"] + [{"t": "deq", "norm": n} for n in "abc"] + [{"t": "page", "norm": "a"}, {"t": "failure", "norm": "b", "kind": "timeout"}]
    rows += [{"t": "stat", "title": "T"}, {"t": "stat", "title": ""}, {"t": "route", "norm": "a", "target": "1"}, {"t": "route", "norm": "a", "target": "2"}, {"t": "odd"}]
    log = journal(spark, rows)
    s = replay.summary(log).first()
    assert (s.n_pages, s.n_discovered, s.n_failures, s.n_pending, s.n_routes, s.title, s.can_finish) == (1, 4, 2, 1, 1, "T", True)
    assert {(r.norm, r.kind) for r in replay.failures(log).collect()} == {("b", "timeout"), ("c", "interrupted")}
    assert replay.routes(log).first().target == "2"
    said = {(r.kind, r.message) for r in replay.finished(log).collect()}
    assert ("cancelled", "Capture was interrupted before finishing; 1 discovered page(s) were never captured.") in said
    assert replay.summary(log.limit(0)).count() == 0


def test_blank_and_stale_results(spark):
    docs = spark.createDataFrame([(1, "Alpha title", "nothing"), (2, "other", "the alpha body of words"), (3, "alpha", "gone")], "page_id long, title string, body string")
    pages = docs.where("page_id <> 3").select("page_id", "title", F.lit("n").alias("norm"))
    assert results.page_results(docs, pages, "  ").count() == 0
    assert {r.page_id for r in results.page_results(docs, pages, "alph").collect()} == {1, 2}
    assert results.page_results(docs, pages, "alpha bod").first().snippet == "…alpha body of words"
    assert results.page_results(docs, pages, '"-(').count() == 0


def test_posts_of_a_page(spark):
    html = """<div id="postlist"></div><article id="post-7" class="message"><a href="/members/ann/">Ann</a><time>Monday</time><a class="post-number">#12</a>
      <div class="message-body">Hello <b>there</b><blockquote>old</blockquote></div></article><div id="POST_8"><span itemprop="name">Bob</span><p>Plain words</p></div>"""
    out = spark.createDataFrame([(html,), (None,), ("<p>none</p>",)], "h string").select(F.explode(posts.posts(F.col("h"))).alias("p")).select("p.*").collect()
    assert [(r.anchor, r.author, r.profile, r.written, r.number, r.body) for r in out] == [("post-7", "Ann", "/members/ann/", "Monday", 12, "Hello there"), ("POST_8", "Bob", None, None, 2, "BobPlain words")]


def test_eligibility_takes_the_first_reason(spark):
    rows = [("https://a.org/", True, True, True), ("ftp://a.org/", False, True, True), ("https://a.org/", False, True, True), ("https://a.org/", False, False, False), ("https://x.bad.net/", False, False, True), ("https://notbad.net/", False, False, True)]
    df = spark.createDataFrame(rows, "url string, private boolean, paused boolean, auto boolean")
    status = library.capture_status(F.col("url"), F.col("private"), F.col("paused"), F.col("auto"), library.domain_excluded(urls.host(F.col("url")), [" Bad.NET", ""]))
    assert [r[0] for r in df.select(status).collect()] == ["skipped-private", "skipped-non-http", "skipped-excluded", "skipped-excluded", "skipped-excluded", None]


def test_thread_key_drops_the_first_page_number_only(spark):
    got = spark.createDataFrame([("https://f.org/t/1/page/2/page/3/?page=4&x=1",), ("https://f.org/page/2",)], "u string").select(urls.thread_key(F.col("u"))).collect()
    assert [r[0] for r in got] == ["https://f.org/t/1/page/3?x=1", "https://f.org/"]


def test_robots_rules_by_host(spark):
    paths = spark.createDataFrame([("a", "/x/y"), ("a", "/x"), ("a", "/z"), ("b", "/x"), ("a", "")], "host string, path string")
    rules = spark.createDataFrame([("a", "/x", False), ("a", "/x/", True), ("a", "/z", False), ("a", "/z", True), ("a", "", False)], "host string, rule string, allow boolean")
    assert {(r.host, r.path): r.allowed for r in crawl.robots_allowed(paths, rules).collect()} == {("a", "/x/y"): True, ("a", "/x"): False, ("a", "/z"): True, ("b", "/x"): True, ("a", ""): True}


def test_a_failure_under_a_raw_url_outlives_its_retry(spark):
    pages = spark.createDataFrame([("p",), ("q",)], "norm string")
    failed = spark.createDataFrame([("u", "timeout"), ("u#x", "timeout"), ("v", "timeout")], "url string, kind string")
    outcomes = spark.createDataFrame([("u", "u", True, None), ("v", "v", False, "fetch-failed"), ("q", "q", True, None)], "url string, norm string, ok boolean, kind string")
    kept, left = archive.retried(pages, failed, outcomes)
    assert sorted(r.norm for r in kept.collect()) == ["p", "q", "u"]
    assert {(r.url, r.kind) for r in left.collect()} == {("u#x", "timeout"), ("v", "fetch-failed")}


def test_imports_are_checked(spark):
    good = "01234567-89ab-cdef-0123-456789abcdef"
    rows = [
        (good, "u", "t", "success", 1, [], True, None, "abc", 0),
        (good.replace("0", "1"), "u", "t", "success", 1, [], True, "bad", "abc", 2),
        (good.replace("0", "2"), "u", "t", "odd", 1, [], False, None, None, 0),
        ("../up", "u", "t", "success", 1, [], False, None, None, 0),
        (good.replace("0", "3"), "u", "t", "failed", 1, [], False, None, None, 0),
    ]
    entries = spark.createDataFrame(rows, "id string, canonical_url string, title string, status string, size long, tags array<string>, has_text boolean, text_sha256 string, content string, n_warnings long")
    out = library.import_outcomes(entries, entries.where("status = 'failed'")).collect()
    assert {(r.id, r.outcome, r.has_text, r.size_bytes, r.n_warnings) for r in out} == {
        (rows[0][0], "imported", True, 3, 0), (rows[1][0], "imported", False, 0, 3), (rows[2][0], "failed", False, 0, 0), ("../up", "failed", False, 0, 0), (rows[4][0], "skipped", False, 0, 0),
    }
