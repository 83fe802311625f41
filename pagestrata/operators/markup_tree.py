"""Pages read as trees: texts, links and forum posts by containers, over the tokens of functions.markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.markup import attr, lexed, nest, trimmed
from pagestrata.operators.library import utf16_length

# Fixed values of the format: ids of posts, bounds, and the names by which parts of a post are known.
POST_ID = r"(?i)^post[-_]?\d+$"
LEAST_CHARS, MOST_HOPS, BODY_CHARS, LINK_CHARS, TEXT_CHARS = 40, 8, 20_000, 200, 5_000_000
POST_CLASS = r"(?i)message|post|card"
PROFILE_PATHS = ("/members/", "/member/", "/user/", "/profile/")
NAME_CLASSES = ("username", "author", "postauthor")
NUMBER_CLASSES = ("post-number", "postcount", "message-number")
BODY_CLASSES = ("postcontent", "post-content", "message-body", "messageText")
LEFT_OUT_NAMES, LEFT_OUT_CLASSES = ("script", "style", "input", "textarea", "select", "header", "blockquote"), ("signature", "quote")
UNREAD = ("script", "style", "noscript", "textarea")

#: What elements are marked for: headers, names of authors, what bodies leave out, forms, what texts leave out.
HEADER, NAMED, LEFT_OUT, FORM, UNSHOWN, BODY, HEAD = range(7)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_class(token: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(attr(token, "class"), r"\s+"), F.array(*[F.lit(n) for n in names])), F.lit(False))


def _marks(token: Column) -> Column:
    name = token["name"]
    marks = {
        HEADER: name == "header",
        NAMED: has_class(token, NAME_CLASSES),
        LEFT_OUT: name.isin(*LEFT_OUT_NAMES) | has_class(token, LEFT_OUT_CLASSES),
        FORM: name == "form",
        UNSHOWN: name.isin(*UNREAD),
        BODY: name == "body",
        HEAD: name.isin("head", "title"),
    }
    bits = sum((F.when(c, 1 << b).otherwise(0) for b, c in marks.items()), F.lit(0))
    return F.when(token["kind"] == "start", bits).otherwise(0)


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with _tokens, _texts (each token's text) and _tree in place of html."""
    own = [c for c in pages.columns if c != html]
    read = pages.withColumn("_tokens", lexed(F.col(html))).select(*own, "_tokens")
    texts = F.transform("_tokens", lambda t: t["text"])
    return read.select(*own, "_tokens", texts.alias("_texts"), nest(F.col("_tokens"), F.transform("_tokens", _marks), HEAD + 1).alias("_tree"))


def _text(start: Column, end: Column) -> Column:
    """The text content between two tokens."""
    return F.array_join(F.slice("_texts", start + 1, F.greatest(end - start, F.lit(0))), "")


def _end(i: Column) -> Column:
    return F.get(F.col("_tree.end"), i)


def texts(pages: DataFrame) -> DataFrame:
    """(page columns, text): the text content of bodies, but for scripts, styles and what is typed into text areas; a page without a body tag is all body but for its head."""
    body = F.exists(F.col("_tokens"), lambda t: (t["kind"] == "start") & (t["name"] == "body"))

    def shown(x: Column, i: Column) -> Column:
        near = lambda mark: F.get(F.col(f"_tree.near_{mark}"), i)
        placed = F.when(F.col("_has_body"), near(BODY) >= 0).otherwise(near(HEAD) < 0)
        return placed & (near(UNSHOWN) < 0)

    rows = parsed(pages).withColumn("_has_body", body)
    kept = F.array_join(F.filter("_texts", shown), "")
    return rows.withColumn("text", F.substring(kept, 1, TEXT_CHARS)).drop("_tokens", "_texts", "_tree", "_has_body")


def links(pages: DataFrame) -> DataFrame:
    """(page columns, pos, href, text, rel, download, in_form): every anchor with an address, in document order."""

    def link(t: Column, i: Column) -> Column:
        return F.struct(
            attr(t, "href").alias("href"),
            F.substring(trimmed(_text(i, _end(i))), 1, LINK_CHARS).alias("text"),
            F.coalesce(attr(t, "rel"), F.lit("")).alias("rel"),
            attr(t, "download").isNotNull().alias("download"),
            (F.get(F.col(f"_tree.near_{FORM}"), i) >= 0).alias("in_form"),
        )

    is_link = lambda t: (t["kind"] == "start") & (t["name"] == "a") & (F.coalesce(attr(t, "href"), F.lit("")) != "")
    found = F.filter(F.transform("_tokens", lambda t, i: F.when(is_link(t), link(t, i))), lambda x: x.isNotNull())
    own = [c for c in pages.columns if c != "html"]
    return parsed(pages).select(*own, F.posexplode(found).alias("pos", "_l")).select(*own, "pos", "_l.*")


def forum_posts(pages: DataFrame) -> DataFrame:
    """(page columns, post_id, anchor, author, profile, written, number, body) of elements whose id is post-N, in document order.

    An element that holds little text is a marker: its post is the nearest element around it, within
    MOST_HOPS, that holds LEAST_CHARS and has a class of posts, else the nearest with that much text. Author, time
    and number come from microdata, else from links, classes and time elements, those outside headers and with text
    first; the body ends with its own element. post_id is page_id and anchor.
    """
    own = [c for c in pages.columns if c != "html"]
    elements = F.filter(
        F.transform(
            "_tokens",
            lambda t, i: F.when(
                t["kind"] == "start",
                F.struct(
                    i.alias("i"), _end(i).alias("end"), F.get(F.col(f"_tree.near_{HEADER}"), i).alias("header"), t.alias("t"), (trimmed(_text(i, _end(i))) != "").alias("says")
                ),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    anchors = F.filter(F.transform("_tokens", lambda t, i: F.struct(i.alias("i"), attr(t, "id").alias("id"))), lambda a: F.coalesce(a["id"].rlike(POST_ID), F.lit(False)))

    def long_enough(i: Column) -> Column:
        return utf16_length(trimmed(_text(i, _end(i)))) >= LEAST_CHARS

    def climb(acc: Column, _: Column) -> Column:
        node = acc["node"]
        enough = long_enough(node)
        like_post = F.coalesce(attr(F.get("_tokens", node), "class").rlike(POST_CLASS), F.lit(False))
        up = F.struct(
            F.get(F.col("_tree.parent"), node).alias("node"),
            F.when((acc["other"] < 0) & enough, node).otherwise(acc["other"]).alias("other"),
            F.when(enough & like_post, node).otherwise(acc["found"]).alias("found"),
        )
        return F.when((acc["found"] >= 0) | (node < 0), acc).otherwise(up)

    def container(i: Column) -> Column:
        start = F.struct(F.get(F.col("_tree.parent"), i).alias("node"), F.lit(-1).alias("other"), F.lit(-1).alias("found"))
        pick = lambda a: F.when(a["found"] >= 0, a["found"]).when(a["other"] >= 0, a["other"]).otherwise(i)
        return F.when(long_enough(i), i).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(MOST_HOPS)), start, climb, pick))

    rows = parsed(pages).withColumn("_anchors", anchors).where(F.size("_anchors") > 0).withColumn("_elements", elements)
    each = rows.select(*own, "_tokens", "_texts", "_tree", "_elements", F.posexplode("_anchors").alias("_nth", "_anchor"))
    each = each.withColumn("_c", container(F.col("_anchor.i"))).withColumn("_c_end", _end(F.col("_c")))
    each = each.withColumn("_within", F.filter("_elements", lambda e: (e["i"] > F.col("_c")) & (e["i"] < F.col("_c_end")))).drop("_elements")

    name = lambda e: e["t"]["name"]
    prop = lambda value: lambda e: F.coalesce(attr(e["t"], "itemprop") == value, F.lit(False))
    href_has = lambda e, *parts: F.coalesce(_any(attr(e["t"], "href").contains(p) for p in parts), F.lit(False))
    first = lambda pred, among=F.col("_within"): F.get(F.filter(among, pred), F.lit(0))
    said = lambda e: F.nullif(trimmed(_text(e["i"], e["end"])), F.lit(""))
    meta = lambda e: F.when(name(e) == "meta", F.nullif(attr(e["t"], "content"), F.lit(""))).otherwise(said(e))

    def preferred(pred) -> Column:
        def ranked(e: Column) -> Column:
            outside = e["header"] <= F.col("_c")
            rank = F.when(outside & e["says"], 0).when(outside, 1).when(e["says"], 2).otherwise(3)
            return F.struct(rank.alias("rank"), e["i"].alias("i"))

        best = F.array_min(F.transform(F.filter("_within", pred), ranked))
        return first(lambda e: e["i"] == best["i"])

    author = first(prop("author"))
    each = each.withColumn("_author", author)
    part = lambda value: first(lambda e: prop(value)(e) & (e["i"] > F.col("_author.i")) & (e["i"] < F.col("_author.end")))
    each = each.withColumns({"_a_name": part("name"), "_a_url": part("url")})
    around = lambda e: F.get(F.col(f"_tree.near_{NAMED}"), F.get(F.col("_tree.parent"), e["i"])) >= 0
    each = each.withColumns(
        {
            "_m_name": meta(F.col("_a_name")),
            "_m_url": F.coalesce(F.nullif(attr(F.col("_a_url.t"), "href"), F.lit("")), meta(F.col("_a_url"))),
            "_link": preferred(lambda e: (name(e) == "a") & (href_has(e, *PROFILE_PATHS) | F.coalesce(around(e), F.lit(False)))),
            "_named": preferred(lambda e: has_class(e["t"], NAME_CLASSES)),
            "_dated": first(prop("datePublished")),
            "_timed": preferred(lambda e: (name(e) == "time") & attr(e["t"], "datetime").isNotNull()),
            "_time": preferred(lambda e: name(e) == "time"),
            "_place": first(prop("position")),
            "_number": preferred(lambda e: ((name(e) == "a") & href_has(e, "#post")) | has_class(e["t"], NUMBER_CLASSES)),
            "_body": first(lambda e: prop("text")(e) | has_class(e["t"], BODY_CLASSES) | (name(e) == "article")),
        }
    )
    known = F.col("_m_name").isNotNull() | F.col("_m_url").isNotNull()
    linked = F.col("_link").isNotNull()
    b_start, b_end = F.coalesce("_body.i", "_c"), F.coalesce("_body.end", "_c_end")
    kept = F.filter(F.slice("_texts", b_start + 1, b_end - b_start), lambda x, k: F.get(F.col(f"_tree.near_{LEFT_OUT}"), b_start + k) <= b_start)
    number = lambda text, pattern: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("")).cast("int")
    return each.select(
        *own,
        F.concat_ws("#", F.col("page_id").cast("string"), F.col("_anchor.id")).alias("post_id"),
        F.col("_anchor.id").alias("anchor"),
        F.when(known, F.col("_m_name")).when(linked, said(F.col("_link"))).otherwise(said(F.col("_named"))).alias("author"),
        F.when(known, F.col("_m_url")).when(linked, F.nullif(attr(F.col("_link.t"), "href"), F.lit(""))).alias("profile"),
        F.coalesce(meta(F.col("_dated")), F.when(F.col("_timed").isNotNull(), attr(F.col("_timed.t"), "datetime")).otherwise(said(F.col("_time")))).alias("written"),
        F.coalesce(number(meta(F.col("_place")), r"^\s*([+-]?\d{1,9})"), number(said(F.col("_number")), r"#?(\d{1,7})"), F.col("_nth") + 1).alias("number"),
        F.substring(trimmed(F.array_join(kept, "")), 1, BODY_CHARS).alias("body"),
    )
