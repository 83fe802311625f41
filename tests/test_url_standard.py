"""Cases of the URL standard, and queries of hrefs against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import url_standard, urls

STANDARD = [
    ("  HTTP://Example.COM:80/a b?q=a b'#f g` ", "http://example.com/a%20b?q=a%20b%27#f%20g%60"),
    ("https:\\\\example.com\\a\\..\\b?x\\y", "https://example.com/b?x\\y"),
    ("https:/example.com", "https://example.com/"),
    ("https:example.com/x", "https://example.com/x"),
    ("https://e.com?x", "https://e.com/?x"),
    ("https://e.com/?", "https://e.com/?"),
    ("https://e.com/a/%2e%2E/b/%2e", "https://e.com/b/"),
    ("https://e.com/a/./b/../..", "https://e.com/"),
    ("https://e.com/..%2fx", "https://e.com/..%2fx"),
    ("https://e.com/é/\U0001f600?ü#ñ", "https://e.com/%C3%A9/%F0%9F%98%80?%C3%BC#%C3%B1"),
    ("https://e.com/{a}|^[b]", "https://e.com/%7Ba%7D|%5E[b]"),
    ("ht\ntps://e.\tcom/x", "https://e.com/x"),
    ("https://Bücher.example/", "https://xn--bcher-kva.example/"),
    ("https://例え。テスト/", "https://xn--r8jz45g.xn--zckzah/"),
    ("https://b%C3%BCcher.example", "https://xn--bcher-kva.example/"),
    ("https://ex%41mple.com", "https://example.com/"),
    ("https://ex%zzmple.com", None),
    ("https://a b.com/", None),
    ("https://a<b.com/", None),
    ("https:///", None),
    ("https://@/", None),
    ("http://127.1/", "http://127.0.0.1/"),
    ("http://0x7f.0.0.1", "http://127.0.0.1/"),
    ("http://017700000001/", "http://127.0.0.1/"),
    ("http://4294967295", "http://255.255.255.255/"),
    ("http://4294967296", None),
    ("http://1.2.3.256", None),
    ("http://1.2.3.4.5", None),
    ("http://1.2.3.08", None),
    ("http://1.2.3.4.", "http://1.2.3.4/"),
    ("http://a.b.4x/", "http://a.b.4x/"),
    ("http://99999999999999999999/", None),
    ("http://[::1]:8080/x", "http://[::1]:8080/x"),
    ("http://[2001:DB8:0:0:1:0:0:1]/", "http://[2001:db8::1:0:0:1]/"),
    ("http://[0:0:0:0:0:0:0:0]/", "http://[::]/"),
    ("http://[1:0:0:0:0:0:0:0]", "http://[1::]/"),
    ("http://[::ffff:192.0.2.1]/", "http://[::ffff:c000:201]/"),
    ("http://[1::2::3]/", None),
    ("http://[1:2:3:4:5:6:7]/", None),
    ("http://[1:2:3:4:5:6:7:8:9]/", None),
    ("http://[12345::]/", None),
    ("https://e.com:443/", "https://e.com/"),
    ("https://e.com:0443/", "https://e.com/"),
    ("https://e.com:/x", "https://e.com/x"),
    ("https://e.com:0080/", "https://e.com:80/"),
    ("https://e.com:65535/", "https://e.com:65535/"),
    ("https://e.com:65536/", None),
    ("https://e.com:8x/", None),
    ("https://me:p w@e.com/", "https://me:p%20w@e.com/"),
    ("https://a@b@e.com/", "https://a%40b@e.com/"),
    ("https://:@e.com/", "https://e.com/"),
    ("https://me:@e.com/", "https://me@e.com/"),
    ("ftp://e.com/", None),
    ("mailto:a@b.com", None),
    ("not a url", None),
    ("", None),
    (None, None),
]
NORMAL = [
    ("https://E.com/p\\q/?b=%zz%C3%A9&a=ü#x", "https://e.com/p/q?a=%C3%BC&b=%25zz%C3%A9"),
    ("https://e.com/a/../about/", "https://e.com/about"),
    ("https://Bücher.example/?utm_source=x", "https://xn--bcher-kva.example/"),
    ("http://0x7f.1/x?", "http://127.0.0.1/x"),
    ("https://e.com/a b", "https://e.com/a%20b"),
    ("https://e.com:65536/", None),
    ("javascript:alert(1)", None),
    ("file:///etc/passwd", None),
]


def mapped(spark, f, cases):
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, url string")
    return [r["x"] for r in rows.select("i", f(F.col("url")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(("f", "cases"), [(url_standard.standard, STANDARD), (urls.normalize_standard, NORMAL)])
def test_cases(spark, f, cases):
    found = mapped(spark, f, cases)
    wrong = [(u, x, y) for (u, x), y in zip(cases, found, strict=True) if x != y]
    assert not wrong


def test_punycode_equals_python(spark):
    rng = random.Random(5)
    letters = "abz-09\u00e9\u00df\u03bb\u0436\u4f8b\u3048\uac00\U0001f600"
    labels = ["".join(rng.choices(letters, k=rng.randint(1, 30))) + "\u00fc" for _ in range(150)]
    assert mapped(spark, url_standard.punycode, [(x, None) for x in labels]) == [x.encode("punycode").decode() for x in labels]


def test_normalized_urls_can_be_grouped_and_joined(spark):
    rows = spark.createDataFrame([("https://B\u00fccher.example/a/",), ("https://xn--bcher-kva.example/a",)], "url string")
    assert rows.groupBy(urls.normalize_standard(F.col("url")).alias("n")).count().collect() == [("https://xn--bcher-kva.example/a", 2)]
    other = rows.select(F.col("url").alias("u"))
    assert rows.join(other, urls.normalize_standard(F.col("url")) == urls.normalize_standard(F.col("u"))).count() == 4


def test_standard_keeps_what_it_wrote(spark):
    written = [(x, x) for _, x in STANDARD if x]
    assert mapped(spark, url_standard.standard, written) == [x for x, _ in written]
