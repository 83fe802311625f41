"""Forum posts of a page as Column expressions over HTML.

A post begins at an element whose id is post-N and reaches to the next one. Author,
profile, time and number come from microdata first, then from class names and links.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of posts, the bound of a body's characters, and what a body leaves out.
POST_START = r'(?i)(?=<[a-z]+\b[^>]*\sid="post[-_]?\d+")'
POST_ID = r'(?i)^<[a-z]+\b[^>]*\sid="(post[-_]?\d+)"'
MAX_BODY_CHARS = 20_000
LEFT_OUT = r"(?is)<(script|style|textarea|select|header|blockquote)\b[^>]*>.*?</\1>|<input\b[^>]*>"
AUTHOR = (r'(?is)itemprop="name"[^>]*>([^<]+)<', r'(?is)<a\b[^>]*href="[^"]*/(?:members|member|user|profile)/[^"]*"[^>]*>([^<]+)</a>', r'(?is)class="(?:username|author|postauthor)"[^>]*>([^<]+)<')
PROFILE = (r'(?is)itemprop="url"[^>]*href="([^"]*)"', r'(?is)<a\b[^>]*href="([^"]*/(?:members|member|user|profile)/[^"]*)"')
WRITTEN = (r'(?is)itemprop="datePublished"[^>]*content="([^"]*)"', r'(?is)<time\b[^>]*datetime="([^"]*)"', r"(?is)<time\b[^>]*>([^<]+)</time>")
NUMBER = (r'(?is)itemprop="position"[^>]*content="(\d+)"', r'(?is)class="(?:post-number|postcount|message-number)"[^>]*>#?(\d{1,7})')
BODY = r'(?is)<div\b[^>]*class="(?:postcontent|post-content|message-body|messageText)"[^>]*>(.*?)</div>'


def first_of(text: Column, patterns: tuple[str, ...]) -> Column:
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, LEFT_OUT, ""), "<[^>]*>", ""), r"[ \t\r\n]+", " "))


def posts(html: Column) -> Column:
    """array<struct<anchor, author, profile, written, number, body>> in document order; a post without a number counts its place."""
    parts = F.filter(F.split(html, POST_START), lambda p: p.rlike(POST_ID))

    def one(part: Column, i: Column) -> Column:
        body = F.regexp_extract(part, BODY, 1)
        return F.struct(
            F.regexp_extract(part, POST_ID, 1).alias("anchor"),
            first_of(part, AUTHOR).alias("author"),
            first_of(part, PROFILE).alias("profile"),
            first_of(part, WRITTEN).alias("written"),
            F.coalesce(first_of(part, NUMBER).cast("int"), i + 1).alias("number"),
            F.substring(plain(F.when(body != "", body).otherwise(part)), 1, MAX_BODY_CHARS).alias("body"),
        )

    return F.transform(parts, one)
