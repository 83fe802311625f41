"""HTML tokens, trees and forum posts against plain Python walks of the trees that pages were written from."""

import html as stdlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import markup
from pagestrata.operators import markup_tree

TOKENS = [
    ("a< b", [("text", "", "a"), ("text", "", "<"), ("text", "", " b")]),
    ('<p class="x>y">t</p>', [("start", "p", ""), ("text", "", "t"), ("end", "p", "")]),
    ("<!-- <p> --><i>", [("start", "i", "")]),
    ("<!--><i><!-- x --!>y", [("start", "i", ""), ("text", "", "y")]),
    ("<script>if (a</p>b) {}</SCRIPT >x", [("start", "script", ""), ("text", "", "if (a</p>b) {}"), ("end", "script", ""), ("text", "", "x")]),
    ("<style>&amp;</style><title>&amp;</title>", [("start", "style", ""), ("text", "", "&amp;"), ("end", "style", ""), ("start", "title", ""), ("text", "", "&"), ("end", "title", "")]),
    ("<!DOCTYPE html><?x?></ 3><br/>", [("start", "br", "")]),
    ("x<a href='y", [("text", "", "x")]),
    ("<SCRIPTS>a</SCRIPTS>", [("start", "scripts", ""), ("text", "", "a"), ("end", "scripts", "")]),
    ("<textarea><b></textarea>", [("start", "textarea", ""), ("text", "", "<b>"), ("end", "textarea", "")]),
    ("<script>never ends", [("start", "script", ""), ("text", "", "never ends")]),
    (None, []),
    ("", []),
]
ATTRIBUTES = [
    ("<a href=x title='it&apos;s' DATA-a = \"q&lt;>\" checked x=>", {"href": "x", "title": "it's", "data-a": "q<>", "checked": "", "x": ""}),
    ("<a href=/b/ c/d>", {"href": "/b/", "c": "", "d": ""}),
    ("<a x=1 x=2>", {"x": "1"}),
    ("<a b='\n' c=d'e\"f>", {"b": "\n", "c": "d'e\"f"}),
    ("<a>", {}),
]


def of(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, html string")
    return [r.x for r in rows.select("i", column(F.col("html")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    found = of(spark, [h for h, _ in TOKENS], markup.lexed)
    assert [[(t.kind, t.name, t.text) for t in ts] for ts in found] == [want for _, want in TOKENS]


def test_attributes(spark):
    for ts, (_, want) in zip(of(spark, [h for h, _ in ATTRIBUTES], markup.lexed), ATTRIBUTES, strict=True):
        got = {}
        for a in ts[0].attributes:
            got.setdefault(a.name, a.value)
        assert got == want


def test_character_references_equal_the_standard_library(spark):
    rnd = random.Random(1)
    parts = ["&", "&amp", "&amp;", "&lt;", "&notit;", "&notin;", "&#65;", "&#x41", "&#xe9;", "&#8364;", "&#128;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999;", "&nbsp", "&nope;", "&copyx", "&NotEqualTilde;", "x", " ", ";", "é", "&#;", "&#x;"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    assert of(spark, texts, markup.decoded) == [stdlib.unescape(t) for t in texts]


def test_long_pages(spark):
    big = "<div a='" + "x" * 300_000 + "'>" + "<p>text &amp; more" * 5_000 + "<!--" + "y" * 300_000 + "--><script>" + "z<" * 100_000 + "</script>"
    ts = of(spark, [big], markup.lexed)[0]
    assert sum(t.name == "p" for t in ts) == 5_000 and sum(t.kind == "text" and t.text == "text & more" for t in ts) == 5_000


class Node:
    def __init__(self, name, attributes=(), children=()):
        self.name, self.attributes, self.children, self.parent = name, dict(attributes), list(children), None
        for c in self.children:
            if isinstance(c, Node):
                c.parent = self

    def html(self):
        quote = lambda v: '"' + stdlib.escape(v) + '"'
        own = "".join(f" {k}={quote(v)}" for k, v in self.attributes.items())
        if self.name in markup.VOID:
            return f"<{self.name}{own}>"
        return f"<{self.name}{own}>" + "".join(c.html() if isinstance(c, Node) else stdlib.escape(c) for c in self.children) + f"</{self.name}>"

    def text(self):
        return "".join(c.text() if isinstance(c, Node) else c for c in self.children)

    def inside(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.inside()

    def classes(self):
        return self.attributes.get("class", "").split()


def said(n):
    return n.text().strip() or None


def meta(n):
    if n is None:
        return None
    return (n.attributes.get("content") or None) if n.name == "meta" else said(n)


def plain_posts(root, page_id):
    out = []
    everything = [root, *root.inside()]
    for nth, a in enumerate(n for n in everything if re.match(r"post[-_]?\d+$", n.attributes.get("id", ""), re.I)):
        box, other, node = None, None, a.parent
        if len(a.text().strip()) >= 40:
            box = a
        for _ in range(8):
            if box is not None or node is None:
                break
            if len(node.text().strip()) >= 40:
                other = other or node
                if re.search("message|post|card", node.attributes.get("class", ""), re.I):
                    box = node
            node = node.parent
        box = box or other or a
        within = list(box.inside())

        def in_header(n, box=box):
            while n is not None and n is not box:
                if n.name == "header":
                    return True
                n = n.parent
            return False

        def preferred(pred, within=within, in_header=in_header):
            every = [n for n in within if pred(n)]
            return min(every, key=lambda n: (0 if not in_header(n) and said(n) else 1 if not in_header(n) else 2 if said(n) else 3, every.index(n)), default=None)

        first = lambda pred, among=within: next((n for n in among if pred(n)), None)
        prop = lambda v: lambda n: n.attributes.get("itemprop") == v
        names = set(markup_tree.NAME_CLASSES)

        def named_above(n):
            while n.parent is not None:
                n = n.parent
                if names & set(n.classes()):
                    return True
            return False

        author = profile = None
        holder = first(prop("author"))
        if holder is not None:
            own = list(holder.inside())
            author, url = meta(first(prop("name"), own)), first(prop("url"), own)
            profile = (url.attributes.get("href") or meta(url)) if url is not None else None
        if author is None and profile is None:
            link = preferred(lambda n: n.name == "a" and (any(p in n.attributes.get("href", "") for p in markup_tree.PROFILE_PATHS) or named_above(n)))
            if link is not None:
                author, profile = said(link), link.attributes.get("href") or None
            else:
                holder = preferred(lambda n: bool(names & set(n.classes())))
                author = said(holder) if holder is not None else None
        written = meta(first(prop("datePublished")))
        if written is None:
            timed = preferred(lambda n: n.name == "time" and "datetime" in n.attributes)
            plain = preferred(lambda n: n.name == "time")
            written = timed.attributes["datetime"] if timed is not None else said(plain) if plain is not None else None
        placed = re.match(r"\s*([+-]?\d{1,9})", meta(first(prop("position"))) or "")
        if not placed:
            holder = preferred(lambda n: (n.name == "a" and "#post" in n.attributes.get("href", "")) or bool(set(markup_tree.NUMBER_CLASSES) & set(n.classes())))
            placed = re.search(r"#?(\d{1,7})", (said(holder) if holder is not None else None) or "")
        body = first(lambda n: prop("text")(n) or bool(set(markup_tree.BODY_CLASSES) & set(n.classes())) or n.name == "article") or box

        def kept(n):
            left = lambda c: c.name in markup_tree.LEFT_OUT_NAMES or set(c.classes()) & set(markup_tree.LEFT_OUT_CLASSES)
            return "".join(c if isinstance(c, str) else "" if left(c) else kept(c) for c in n.children)

        out.append((f"{page_id}#{a.attributes['id']}", author, profile, written, int(placed[1]) if placed else nth + 1, kept(body).strip()))
    return out


def random_tree(rnd, depth=0):
    words = lambda n: " ".join(rnd.choice(["alpha", "b<c", "d&e", 'quo"te', "ünï", "f > g", "3"]) for _ in range(n))
    children = []
    for _ in range(rnd.randint(0, 5 if depth < 4 else 1)):
        kind = rnd.random()
        if kind < 0.35 or depth > 6:
            children.append(words(rnd.randint(1, 9)))
            continue
        name = rnd.choice(["div", "section", "span", "header", "blockquote", "a", "time", "article", "meta", "input", "b"])
        attributes = {}
        if rnd.random() < 0.25:
            attributes["id"] = f"post-{rnd.randint(1, 99)}" if rnd.random() < 0.8 else "post-x"
        if rnd.random() < 0.4:
            attributes["class"] = " ".join(rnd.sample(["username", "author", "message", "card", "signature", "quote", "message-body", "post-number", "plain"], rnd.randint(1, 2)))
        if rnd.random() < 0.3:
            attributes["itemprop"] = rnd.choice(["author", "name", "url", "datePublished", "position", "text"])
        if name == "a" or rnd.random() < 0.1:
            attributes["href"] = rnd.choice(["/members/7", "/x", "t#post-3", "/user/a?b=1&c=2", ""])
        if name == "time" and rnd.random() < 0.5:
            attributes["datetime"] = "2024-01-02"
        if name == "meta":
            attributes["content"] = rnd.choice(["", "12 x", "Ann"])
        children.append(Node(name, attributes, [] if name in markup.VOID else random_tree(rnd, depth + 1)))
    return children


def posts_of(spark, pages):
    rows = spark.createDataFrame(pages, "page_id long, html string")
    return sorted(((r.page_id, r.post_id, r.author, r.profile, r.written, r.number, r.body) for r in markup_tree.forum_posts(rows).collect()), key=repr)


def test_forum_posts_equal_a_walk_of_the_tree(spark):
    rnd = random.Random(7)
    trees = {i: Node("body", {}, [Node("div", {"class": "post"}, random_tree(rnd)) for _ in range(3)]) for i in range(120)}
    wanted = sorted(((i, *p) for i, t in trees.items() for p in plain_posts(t, i)), key=repr)
    assert len(wanted) > 100 and len({w[2:6] for w in wanted}) > 30
    assert posts_of(spark, [(i, t.html()) for i, t in trees.items()]) == wanted


def test_themes_of_forums(spark):
    long = "words of a post that are long enough to be a post"
    marker = f'<div class="message"><div><span id="post-4"></span></div><div class="message-body">{long} <div>nested</div> end</div></div><p>after</p>'
    micro = f'<article id="post_9"><header><span itemprop="author"><a itemprop="url" href="/u/9"><b itemprop="name">Nine</b></a></span><meta itemprop="position" content="12"></header><div itemprop="text">{long}<blockquote>no</blockquote></div></article>'
    assert posts_of(spark, [(1, marker), (2, micro), (3, None), (4, "<p>none</p>")]) == [
        (1, "1#post-4", None, None, None, 1, f"{long} nested end"),
        (2, "2#post_9", "Nine", "/u/9", None, 12, long),
    ]


@pytest.mark.parametrize(
    "html,text",
    [
        ("<head><title>t</title></head><body>a<script>b</script> <b>c</b>&amp;<textarea>typed</textarea><noscript>n</noscript></body>", "a c&"),
        ("no body <i>tag</i>", "no body tag"),
        ("<body><p>one<p>two</div>three</p></p>four", "onetwothreefour"),
        ("<body><!-- <form> -->x<style>y</style>", "x"),
        (None, ""),
    ],
)
def test_texts(spark, html, text):
    assert markup_tree.texts(spark.createDataFrame([(1, html)], "page_id long, html string")).first().text == text


def test_links_and_their_forms(spark):
    page = "<!-- <form> --><a href='/one' rel=nofollow> One &lt;1&gt; </a><form><div><a href=/two download>Two</a></form></div><a title='a>b' href=\"/three\">3</a><a>none</a><script>'<a href=\"/no\">'</script>"
    rows = markup_tree.links(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(r.pos, r.href, r.text, r.rel, r.download, r.in_form) for r in rows] == [(0, "/one", "One <1>", "nofollow", False, False), (1, "/two", "Two", "", True, True), (2, "/three", "3", "", False, False)]


def test_ends_that_are_left_out():
    kinds, names = zip(*[("start", n) if not n.startswith("/") else ("end", n[1:]) for n in "ul li b li /ul p div p /div table tr td td tr".split()], strict=True)
    end, parent, _ = markup.walk(kinds, names, [0] * len(kinds), 0)
    assert end == [4, 3, 3, 4, -1, 6, 8, 8, -1, 14, 13, 12, 13, 14]
    assert parent == [-1, 0, 1, 0, -1, -1, -1, 6, -1, -1, 9, 10, 10, 9]
