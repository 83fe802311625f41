import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import forms, text
from pagestrata.operators import budget, forum
from pagestrata.sources import zips


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def test_anchors_know_their_form_and_attributes(spark):
    html = "<a href='/a' REL=NoFollow>One <b>two</b> </a><FORM><a class=x href=/b>In</a></FORM><a download href=\"/c.pdf\">C</a><a name=x>none</a>"
    found = one(spark, forms.anchors, html)
    assert [tuple(a) for a in found] == [("/a", "One two", "nofollow", False, False), ("/b", "In", "", False, True), ("/c.pdf", "C", "", True, False)]
    assert one(spark, forms.anchors, None) is None
    assert one(spark, forms.anchors, "") == []


def test_resources(spark):
    html = '<link rel="icon" href="/i.ico"><link rel=next href=/n><link rel="preload" as="font" href="/f.woff"><img src=a.png srcset="b.png 1x,c.png 2x"><video poster="p.jpg"><source src="v.mp4"></video><iframe src="/f"></iframe><script src="s.js"></script><script>x</script>'
    assert [tuple(r) for r in one(spark, forms.resources, html)] == [
        ("/i.ico", "image"), ("/f.woff", "other"), ("a.png", "image"), ("b.png", "image"), ("c.png", "image"),
        ("p.jpg", "image"), ("v.mp4", "media"), ("/f", "frame"), ("s.js", "script"),
    ]


@pytest.mark.parametrize(
    ("html", "cleared"),
    [
        ('<input value="hunter2" type="password">', '<input value="" type="password">'),
        ("<input type=hidden name=csrf value=abc>", '<input type=hidden name=csrf value="">'),
        ('<input name="card_no" value="4111" id=x>', '<input name="card_no" value="" id=x>'),
        ('<input name="q" value="my password">', '<input name="q" value="my password">'),
        ('<textarea name="api-key" rows=2>s3</textarea>', '<textarea name="api-key" rows=2></textarea>'),
        ('<textarea name="note">kept</textarea>', '<textarea name="note">kept</textarea>'),
        (None, None),
    ],
)
def test_credentials_are_cleared(spark, html, cleared):
    assert one(spark, forms.without_credentials, html) == cleared


def test_strings(spark):
    assert one(spark, text.match_query, ' a "b" ') == '"a"* """b"""*'
    assert one(spark, text.match_query, "  ") == ""
    assert one(spark, text.snippet_parts, "x \u0001hit\u0002 y") == ["x ", "hit", " y"]
    assert one(spark, lambda c: text.address(c, "https://s.example/?q="), "a b") == "https://s.example/?q=a%20b"
    assert one(spark, lambda c: text.address(c, "x%s"), "") == "about:blank"
    assert one(spark, text.is_credential_type, "Application/JWT; a=b") is True
    assert one(spark, text.is_credential_type, None) is False


def test_zips_are_split_by_size_and_hostile_ones_refused(spark):
    files = spark.createDataFrame([(f"d/{i}", b"x" * 600) for i in range(10)], "path string, content binary").coalesce(1)
    made = zips.zipped(files, 1000)
    assert sorted(r["n_entries"] for r in made.collect()) == [2] * 5

    def zip_of(*names, size=1):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, b"0" * size)
        return buffer.getvalue()

    rows = [("up", zip_of("ok", "../x")), ("root", zip_of("/x")), ("bomb", zip_of("z", size=4 << 20)), ("junk", b"no"), ("null", None), ("good", zip_of("a/b", "c"))]
    found = zips.entries(spark.createDataFrame(rows, "zip string, content binary")).collect()
    assert {r["zip"]: r["error"] for r in found} == {"up": "unsafe-path", "root": "unsafe-path", "bomb": "compression-bomb", "junk": "not-a-zip", "null": "not-a-zip", "good": None}
    assert sorted(r["path"] for r in found if r["error"] is None) == ["a/b", "c"]


def decide(spark, scope, *links):
    schema = "pos int, page_url string, url string, text string, rel string, download boolean, in_form boolean, depth int, robots_allowed boolean"
    rows = [(i, page, url, "", "", False, False, 0, True) for i, (page, url) in enumerate(links)]
    return [r["decision"] for r in forum.ladder(spark.createDataFrame(rows, schema), scope, ["pos"]).orderBy("pos").collect()]


def test_narrow_forum_scopes(spark):
    section, thread = "https://f.example/forum/cars", "https://f.example/forum/t1"
    found = decide(spark, forum.ForumScope(section, "section"), (section, thread), (section, section + "/page/2"), (section, "https://f.example/shop/x"), (thread, thread + "/page/2"), (thread, "https://f.example/forum/t2"))
    assert found == ["enqueue", "enqueue", "skipped-out-of-forum-scope", "enqueue", "skipped-out-of-forum-scope"]
    assert decide(spark, forum.ForumScope(thread, "thread"), (thread, thread + "/page/2"), (thread, section)) == ["enqueue", "skipped-out-of-forum-scope"]


def test_pagination_hops_are_bounded_per_thread(spark):
    page = "https://f.example/t"
    found = decide(spark, forum.ForumScope("https://f.example/"), *[(page, f"{page}/page/{i}") for i in range(2, 504)])
    assert (found.count("enqueue"), found.count("skipped-trap")) == (500, 2)


def test_budget_tests_bytes_before_pages(spark):
    rows = [(1, 1, 60), (1, 2, 60), (1, 3, 60), (2, 1, 1), (2, 2, 1), (2, 3, 1), (3, 1, 1)]
    found = budget.within_budget(spark.createDataFrame(rows, "archive_id long, seq long, size long"), 2, 100)
    assert {tuple(r) for r in found.collect()} == {(1, 2, 120, "bytes", 1), (2, 2, 2, "pages", 1), (3, 1, 1, None, 0)}
