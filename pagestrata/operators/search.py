"""Full-text search: prefix-AND match, column-weighted BM25 and snippets.

Words are lower-cased and lose the single accents of Latin letters. Words of a query are ANDed; each matches tokens by prefix, in any column. Scores are
negative, lower is better; document frequencies and lengths cover every active
document, whatever filters apply later.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SEPARATOR, PLAIN_SEPARATOR = r"[^\p{L}\p{N}]+", "[^a-z0-9]+"
LIBRARY_WEIGHTS = {"title": 2, "final_url": 1, "domain": 1, "body": 1}


#: Combining marks, which words lose, and lower-case Latin letters with one such mark, by their decompositions.
MARKS = "".join(map(chr, range(0x300, 0x370)))
ACCENTED = {c: d[0] for c in map(chr, range(0x80, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and d[0].islower() and d[1] in MARKS}


def tokens(text: Column) -> Column:
    """Words of text in lower case, without accents; plain text skips the table and is split by ASCII's letters and digits, which are the same."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.translate(low, "".join(ACCENTED) + MARKS, "".join(ACCENTED.values()))
    plain = F.octet_length(low) == F.char_length(low)
    return F.array_remove(F.when(plain, F.split(low, PLAIN_SEPARATOR)).otherwise(F.split(bare, SEPARATOR)), "")


def query_words(text: str) -> list[list[str]]:
    """Each word of a query as its tokens; more than one token is a phrase whose last token is a prefix."""
    import re

    fold = str.maketrans(ACCENTED | dict.fromkeys(MARKS))
    words = [[t for t in re.split(r"[\W_]+", w.lower().translate(fold)) if t] for w in text.split()]
    return [w for w in words if w]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once: as a lambda's variable it isn't repeated wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hits(column: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of tokens, its last token as a prefix."""
    if len(phrase) == 1:
        return F.size(F.filter(column, lambda t: t.startswith(phrase[0])))

    def here(ts: Column, t: Column, i: Column) -> Column:
        inner = [F.get(ts, i + k) == w for k, w in enumerate(phrase[1:-1], 1)]
        return reduce(lambda a, b: a & b, [t == phrase[0], *inner, F.coalesce(F.get(ts, i + len(phrase) - 1).startswith(phrase[-1]), F.lit(False))])

    return bound(column, lambda ts: F.size(F.filter(ts, lambda t, i: here(ts, t, i))))


def search(docs: DataFrame, text: str, weights: Mapping[str, int] = LIBRARY_WEIGHTS) -> DataFrame:
    """docs that match text, with score; blank text matches nothing."""
    words = query_words(text)
    if not words:
        return docs.limit(0).withColumn("score", F.lit(0.0))
    split = docs.select("*", *[tokens(F.col(c)).alias(f"_t_{c}") for c in weights])
    length = reduce(lambda a, b: a + b, [F.size(f"_t_{c}") for c in weights])
    tf = [reduce(lambda a, b: a + b, [hits(F.col(f"_t_{c}"), w) * weight for c, weight in weights.items()]) for w in words]
    counted = split.select(*docs.columns, length.alias("_dl"), *[t.cast("double").alias(f"_tf{i}") for i, t in enumerate(tf)])
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(LEAST_IDF))
        norm = F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_dl") / F.col("_avg"))
        score = score - idf * F.col(f"_tf{i}") * (K1 + 1) / norm
    match = reduce(lambda a, b: a & b, [F.col(f"_tf{i}") > 0 for i in range(len(words))])
    return counted.where(match).join(F.broadcast(stats)).select(*docs.columns, score.alias("score"))


def snippet(text: Column, phrase: list[str], width: int = 10, marks: tuple[str, str] = ("\x01", "\x02")) -> Column:
    """The first window of width words that starts at a hit, hits marked, with an ellipsis where text is cut."""
    hit = lambda w: F.exists(tokens(w), lambda t: t.startswith(phrase[0]))

    def shown(words: Column, start: Column) -> Column:
        window = F.transform(F.slice(words, start + 1, width), lambda w: F.when(hit(w), F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w))
        return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(window, " "), F.when(F.size(words) > start + width, "…").otherwise(""))

    def cut(words: Column) -> Column:
        at = F.get(F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull()), F.lit(0))
        return bound(F.coalesce(at, F.lit(0)), lambda start: shown(words, start))

    return bound(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), cut)


def phrase_hits(parts: Column, words: list[list[str]]) -> Column:
    """Where phrases of a query occur in an array of words: hits in order of their first word, each once, as codes for hit_of.

    A phrase's tokens follow one another, within a word or over several; the last one is a prefix.
    """
    within = F.flatten(F.transform(parts, lambda w, i: F.transform(tokens(w), lambda t: F.struct(t.alias("token"), i.alias("word")))))

    def may_begin(token: Column) -> Column:
        return reduce(lambda a, b: a | b, [token.startswith(p[0]) if len(p) == 1 else token == p[0] for p in words])

    def begins(ts: Column, i: Column, place: int) -> Column:
        *inner, last = words[place]
        there = [F.get(ts, i + k)["token"] == w for k, w in enumerate(inner)]
        start, end = F.get(ts, i), F.get(ts, i + len(inner))
        found = reduce(lambda a, b: a & b, [*there, end["token"].startswith(last)])
        return F.when(found, F.shiftleft(start["word"].cast("long"), HIT_WORD) + F.shiftleft(end["word"] - start["word"], HIT_SPAN) + place)

    def codes(ts: Column) -> Column:
        # most tokens begin no phrase and are left out by one comparison a phrase
        places = F.filter(F.transform(ts, lambda t, i: F.when(may_begin(t["token"]), i)), lambda i: i.isNotNull())
        each = F.transform(places, lambda i: F.array(*[begins(ts, i, p) for p in range(len(words))]))
        return F.array_distinct(F.filter(F.flatten(each), lambda c: c.isNotNull()))

    return bound(within, codes)


#: A hit is a number, as arrays of numbers lose repeats by hashing: from these bits on its first word and the words until its last one, below them its phrase.
#: Queries have at most 256 phrases, phrases at most 65,535 tokens.
HIT_WORD, HIT_SPAN = 24, 8


def hit_of(code: Column) -> tuple[Column, Column, Column]:
    """A hit's first word, last word and phrase."""
    first = F.shiftright(code, HIT_WORD).cast("int")
    return first, first + F.shiftright(code, HIT_SPAN).bitwiseAND(0xFFFF).cast("int"), code.bitwiseAND(0xFF).cast("int")


def best_window(columns: list[Column], words: list[list[str]], width: int = 10, marks: tuple[str, str] = ("\x01", "\x02")) -> Column:
    """struct<n, minus_column, minus_start, text>: the window of width words that holds most of the query's phrases, over all columns.

    Windows start at hits, and hold a phrase that ends in them; the phrase that a window starts at counts, even if it is longer than the window.
    The earlier window wins a tie, and the earlier column over a later one. Phrases are marked whole, overlapping ones together. Null where nothing is hit.
    Time is linear in a text: from a hit on, only as many hits are looked at as can start within a window.
    """
    if len(words) > 256 or max(map(len, words)) > 0xFFFF:
        raise ValueError("a query has at most 256 phrases of at most 65,535 tokens")
    most = width * sum(map(len, words))

    def fits(code: Column, start: Column) -> Column:
        first, last, _ = hit_of(code)
        return (first >= start) & (first < start + width) & ((last < start + width) | (first == start))

    def window(text: Column, place: Column) -> Column:
        parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")

        def best(ps: Column, hits: Column) -> Column:
            def seen(code: Column, i: Column) -> Column:
                start, near = hit_of(code)[0], F.slice(hits, i + 1, most)
                if len(words) == 1:
                    n = F.lit(1)
                elif len(words) < 64:
                    phrases = F.aggregate(near, F.lit(0).cast("long"), lambda acc, h: F.when(fits(h, start), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), hit_of(h)[2]))).otherwise(acc))
                    n = F.bit_count(phrases)
                else:
                    n = F.size(F.array_distinct(F.transform(F.filter(near, lambda h: fits(h, start)), lambda h: hit_of(h)[2])))
                return F.struct(n.cast("int").alias("n"), (-start).alias("minus"))

            top = F.array_max(F.transform(hits, seen))
            return bound(top, lambda t: F.when(t.isNotNull(), F.struct(t["n"].alias("n"), (-place).alias("minus_column"), t["minus"].alias("minus_start"), ps.alias("parts"), hits.alias("hits"))))

        return bound(parts, lambda ps: bound(phrase_hits(ps, words), lambda hits: best(ps, hits)))

    def shown(ps: Column, hits: Column, start: Column) -> Column:
        def text(inside: Column) -> Column:
            def covers(at: Column, from_before: bool) -> Column:
                bounds = lambda h: (hit_of(h)[0] < at if from_before else hit_of(h)[0] <= at) & (at <= hit_of(h)[1])
                return F.exists(inside, bounds)

            def marked(word: Column, k: Column) -> Column:
                at = start + k
                begin = covers(at, False) & ((k == 0) | ~covers(at, True))
                end = covers(at, False) & ((k == width - 1) | ~covers(at + 1, True))
                return F.concat(F.when(begin, marks[0]).otherwise(""), word, F.when(end, marks[1]).otherwise(""))

            return F.array_join(F.transform(F.slice(ps, start + 1, width), marked), " ")

        body = bound(F.filter(hits, lambda h: fits(h, start)), text)
        return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(F.size(ps) > start + width, "…").otherwise(""))

    # one expression for all columns, and one text for the best of their windows
    windows = F.transform(F.array(*[F.coalesce(c, F.lit("")) for c in columns]), window)
    made = lambda b: F.struct(b["n"].alias("n"), b["minus_column"].alias("minus_column"), b["minus_start"].alias("minus_start"), shown(b["parts"], b["hits"], -b["minus_start"]).alias("text"))
    return bound(F.array_max(F.filter(windows, lambda x: x.isNotNull())), lambda b: F.when(b.isNotNull(), made(b)))


def best_snippet(columns: list[Column], words: list[list[str]], width: int = 10, marks: tuple[str, str] = ("\x01", "\x02")) -> Column:
    """The text of the best window, its phrases marked; null where nothing is hit."""
    return best_window(columns, words, width, marks)["text"]


def postings(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(term, n_docs, n_hits): the term statistics of an inverted index."""
    exploded = docs.select(key, F.explode(tokens(F.col(column))).alias("term"))
    return exploded.groupBy("term", key).agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_hits"))
