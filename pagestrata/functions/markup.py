"""HTML read by one lexing pattern into tokens, with entities decoded, and as a tree of nested intervals.

lexed() gives a page's tokens once, as an array: start tags with attributes, end tags, and text.
Comments, declarations and what an unfinished tag at the end holds are left out; scripts, styles,
text areas and the like hold text up to their own end tag, whatever it looks like; attributes
are quoted, bare or without value, and the first of one name counts.

nest() gives, for each token, the element around it and where elements end, as intervals of
token numbers: what lies between an element's start and end is inside it. Elements without content
have none; end tags without a start are ignored; what is still open when an outer element ends, ends
there; list items, paragraphs, table cells and options end where the next one begins.
It walks one page's token names in Python, in Arrow batches; all else are Column expressions.

Defined cases: null and empty pages have no tokens; lone `<` are text.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the HTML standard: elements whose content is text, elements without content, and which starts end which open elements.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")
DECODED_RAW = ("textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
ENDED_BY = (
    {b: {"p"} for b in BLOCKS}
    | {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
    | {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, **{t: {"td", "th", "tr", "tbody", "thead", "tfoot"} for t in ("tbody", "thead", "tfoot")}}
)
BARRIERS = {"p": {"button", "table", "td", "th", "caption", "object", "template"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
TABLE = {"table"}
#: White space that a browser trims.
TRIMMED = "\t\n\x0b\x0c\r                  　﻿"

_NAME = r"[^\s>/][^\s>/=]*+"
_ATTRIBUTE = rf"""{_NAME}(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)|(?!\s*+=))"""
_INSIDE = rf"(?:[\s/]++|{_ATTRIBUTE})*+"
_START = rf"<[a-z][^\s/>]*+{_INSIDE}>"
LEX = "(?is)" + "|".join(
    [
        r"<!--(?:-?>|.*?(?:--!?>|\z))",
        rf"<({'|'.join(RAW)})(?=[\s/>]){_INSIDE}>.*?(?:(?=</\1[\s/>])|\z)",
        _START,
        rf"</[a-z][^\s/>]*+{_INSIDE}>",
        r"<[!?/][^>]*+(?:>|\z)",
        r"<[a-z].*\z",
        r"[^<]++|<",
    ]
)

_WINDOWS = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
#: Entities that count without a semicolon too, as far as in text; longer names first.
_SHORT = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: -len(k)))
_PIECES = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]++|&"


def _code(number: Column) -> Column:
    """The character of a code point, as character references give it."""
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    windows = reduce(lambda acc, kv: acc.when(number == kv[0], kv[1]), _WINDOWS.items(), F.when(F.lit(False), ""))
    wrong = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(wrong, "�").when(number.between(0x80, 0x9F), windows).otherwise(plain)


def decoded(text: Column) -> Column:
    """text with character references decoded; text without `&` is passed on."""
    # constants, which the optimizer reads once
    table, short = (F.from_json(F.lit(json.dumps({k: v for k, v in html5.items() if k.endswith(";") == long})), "map<string,string>") for long in (True, False))

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+)", 1)
        small = F.char_length(F.regexp_replace(digits, "^0+", "")) <= 8
        number = F.when(small, F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
        named = F.try_element_at(table, F.substring(piece, 2, 64))
        prefix = F.regexp_extract(piece, f"^&({_SHORT})", 1)
        brief = F.concat(F.try_element_at(short, prefix), F.substring(piece, F.char_length(prefix) + F.lit(2), F.char_length(piece)))
        return F.when(~piece.startswith("&") | (piece == "&"), piece).when(piece.startswith("&#"), _code(number)).otherwise(F.coalesce(named, F.when(prefix != "", brief), piece))

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), one), "")).otherwise(text)


def lexed(html: Column) -> Column:
    """array<struct<kind, name, attributes: array<struct<name, value>>, text>>; kind is start, end or text."""
    none = F.expr("CAST(array() AS array<struct<name string, value string>>)")
    token = "array<struct<kind string, name string, attributes array<struct<name string, value string>>, text string>>"

    def made(kind: str, name: Column, attributes: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), attributes.alias("attributes"), text.alias("text"))

    def attribute(piece: Column) -> Column:
        name = F.regexp_extract(piece, f"^{_NAME}", 0)
        raw = F.regexp_replace(piece, rf"^{_NAME}(?:\s*+=\s*+)?+", "")
        value = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(raw)
        return F.struct(F.lower(name).alias("name"), decoded(value).alias("value"))

    def tokens(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*+)", 1))
        tag = F.regexp_extract(t, rf"(?is)^{_START}", 0)
        inside = F.regexp_extract(tag, rf"(?is)^<[a-z][^\s/>]*+({_INSIDE})>", 1)
        attributes = F.when(F.trim(inside) == "", none).otherwise(F.transform(F.regexp_extract_all(inside, F.lit(f"(?is){_ATTRIBUTE}"), F.lit(0)), attribute))
        start = made("start", name, attributes, F.lit(""))
        held = F.substring(t, F.char_length(tag) + F.lit(1), F.char_length(t))
        content = made("text", F.lit(""), none, F.when(name.isin(*DECODED_RAW), decoded(held)).otherwise(held))
        return (
            F.when(~t.startswith("<") | (t == "<"), F.array(made("text", F.lit(""), none, decoded(t))))
            .when(t.rlike("^</[A-Za-z]"), F.array(made("end", name, none, F.lit(""))))
            .when(tag == "", F.array().cast(token))
            .when(F.char_length(t) > F.char_length(tag), F.array(start, content))
            .otherwise(F.array(start))
        )

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LEX), F.lit(0)), tokens))


def attr(token: Column, name: str) -> Column:
    """An attribute's value, null without the attribute."""
    return F.get(F.filter(token["attributes"], lambda a: a["name"] == name), F.lit(0))["value"]


def walk(kinds: list[str], names: list[str], marks: list[int], bits: int) -> tuple[list[int], list[int], list[list[int]]]:
    """(end of each element, element around each token, for each bit the nearest marked element around or at each token); -1 where there is none."""
    end, parent = [-1] * len(kinds), [-1] * len(kinds)
    near: list[list[int]] = [[] for _ in range(bits)]
    stack: list[tuple[int, str, tuple[int, ...]]] = []
    outside = (-1,) * bits

    def close(depth: int, at: int) -> None:
        for i, _, _ in stack[depth:]:
            end[i] = at
        del stack[depth:]

    for i, (kind, name) in enumerate(zip(kinds, names, strict=True)):
        if kind == "start" and name in ENDED_BY:
            ended = ENDED_BY[name]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][1] in ended:
                    close(depth, i)
                    if not ended & {"tr", "tbody"}:
                        break
                elif stack[depth][1] in BARRIERS.get(name if name in BARRIERS else "p" if "p" in ended else "", TABLE):
                    break
        elif kind == "end":
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][1] == name), None)
            if depth is not None:
                close(depth, i)
        above = stack[-1][2] if stack else outside
        parent[i] = stack[-1][0] if stack else -1
        here = tuple(i if marks[i] >> b & 1 else above[b] for b in range(bits)) if kind == "start" and marks[i] else above
        for b in range(bits):
            near[b].append(here[b])
        if kind == "start":
            if name in VOID:
                end[i] = i + 1
            else:
                stack.append((i, name, here))
    close(0, len(kinds))
    return end, parent, near


def nest(tokens: Column, marks: Column, bits: int) -> Column:
    """struct<end, parent, near_0, near_1, ...>: arrays beside tokens; marks: a number for each token whose bits mark elements."""

    @F.pandas_udf(f"end array<int>, parent array<int>{''.join(f', near_{b} array<int>' for b in range(bits))}")
    def walked(kinds: pd.Series, names: pd.Series, marked: pd.Series) -> pd.DataFrame:
        rows = [walk(list(k), list(n), list(m), bits) for k, n, m in zip(kinds, names, marked, strict=True)]
        columns = {"end": [r[0] for r in rows], "parent": [r[1] for r in rows]} | {f"near_{b}": [r[2][b] for r in rows] for b in range(bits)}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    return walked(F.transform(tokens, lambda t: t["kind"]), F.transform(tokens, lambda t: t["name"]), marks)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))
