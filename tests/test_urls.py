import pytest
from pyspark.sql import functions as F

from pagestrata.functions import urls

NORMALIZED = [
    ("HTTP://Example.com:80/a/?utm_source=x&b=2&a=1#f", "http://example.com/a?a=1&b=2"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com:8443/x", "https://example.com:8443/x"),
    ("https://me:pw@Example.com/x?q=a b&q=%C3%A9&k&z=%zz", "https://me:pw@example.com/x?k=&q=a+b&q=%C3%A9&z=%25zz"),
    ("ftp://example.com/x", None),
    ("mailto:a@b", None),
    (None, None),
]


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "url string").select(f(F.col("url")).alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "expected"), NORMALIZED)
def test_normalize(spark, url, expected):
    assert one(spark, urls.normalize, url) == expected


def test_shapes(spark):
    assert one(spark, urls.looks_destructive, "https://a.b/x/logout")
    assert one(spark, urls.looks_trap, "https://a.b/x/y/x/y/x/y/x/y")
    assert not one(spark, urls.looks_trap, "https://a.b/x/y")
    assert one(spark, urls.looks_non_content, "https://a.b/members/7")
    assert one(spark, urls.looks_pagination, "https://a.b/t/page/3")
    assert one(spark, urls.thread_key, "https://a.b/t/page/3?p=2&x=1") == "https://a.b/t?x=1"
    assert one(spark, urls.canonicalize, "https://a.b/x/#top") == "https://a.b/x"


def test_user_info_is_no_host(spark):
    url = "https://a.example:secret@b.example:8443/x"
    assert one(spark, urls.host, url) == "b.example"
    assert one(spark, urls.origin, url) == "https://b.example:8443"
    assert one(spark, urls.redact, url) == "https://b.example:8443"
    assert one(spark, urls.path, "https://b.example/@you") == "/@you"


@pytest.mark.parametrize(
    ("href", "expected"),
    [
        ("../g", "https://a.b/b/g"),
        ("./g/", "https://a.b/b/c/g/"),
        ("../../../../g?x=../y#/../z", "https://a.b/g?x=../y#/../z"),
        ("..", "https://a.b/b/"),
        (".", "https://a.b/b/c/"),
        ("../../..", "https://a.b/"),
        ("/x/./y/../z", "https://a.b/x/z"),
        ("g..h", "https://a.b/b/c/g..h"),
        ("https://c.d/e/../f", "https://c.d/f"),
        ("mailto:a@b", "mailto:a@b"),
        ("", "https://a.b/b/c/d?q"),
    ],
)
def test_resolve(spark, href, expected):
    assert one(spark, lambda h: urls.resolve(h, F.lit("https://a.b/b/c/d?q#f")), href) == expected
