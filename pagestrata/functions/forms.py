"""Anchors with their attributes, resources, and the clearing of credentials, as Column expressions over HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORM_EDGE = r"(?i)(?=<form\b)|(?<=</form>)"
ANCHOR_WHOLE = r"(?is)<a\s[^>]*>.*?</a>"
RESOURCE_TAG = r"(?is)<(?:link|img|source|video|iframe|frame|script)\b[^>]*>"
MAX_LINK_TEXT = 200
# Names of fields that hold credentials or payment data.
SENSITIVE_FIELD = "pass|passwd|pwd|secret|token|api[-_]?key|auth|session|credit|card|cvv|cvc|iban|ssn|social|routing|account[-_]?number|otp|2fa|mfa|security[-_]?code"
_CLEARED = rf"""(?=[^>]*\s(?:type\s*=\s*["']?(?:password|hidden)\b|autocomplete\s*=\s*["']?(?:cc-|new-password|current-password)|(?:name|id|autocomplete)\s*=\s*["']?[^"'>]*(?:{SENSITIVE_FIELD})))"""
VALUE = r"""\svalue\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, quoted or bare; empty where absent."""
    found = F.regexp_extract(tag, rf"""(?is)^<[^>]*?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(found, r"""^["']|["']$""", "")


def anchors(html: Column) -> Column:
    """array<struct<href, text, rel, download, in_form>> of a page's anchors that have an href, in document order."""

    def of_piece(piece: Column) -> Column:
        in_form = F.lower(F.substring(piece, 1, 5)) == "<form"

        def one(a: Column) -> Column:
            tag = F.regexp_extract(a, r"(?is)^<a\s[^>]*>", 0)
            words = F.regexp_replace(F.regexp_replace(a, r"<[^>]*>", ""), r"^\s+|\s+$", "")
            return F.struct(
                attribute(tag, "href").alias("href"),
                F.substring(words, 1, MAX_LINK_TEXT).alias("text"),
                F.lower(attribute(tag, "rel")).alias("rel"),
                tag.rlike(r"(?is)\sdownload(\s|=|>|/)").alias("download"),
                in_form.alias("in_form"),
            )

        return F.filter(F.transform(F.regexp_extract_all(piece, F.lit(ANCHOR_WHOLE), F.lit(0)), one), lambda a: a["href"] != "")

    return F.flatten(F.transform(F.split(html, FORM_EDGE), of_piece))


def resources(html: Column) -> Column:
    """array<struct<href, kind>> of what a page loads, in document order, srcset candidates after src."""

    def of_tag(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"^<([A-Za-z]+)", 1))
        rel = F.lower(attribute(tag, "rel"))
        words = F.split(rel, r"\s+")
        font = F.array_contains(words, "preload") & (F.lower(attribute(tag, "as")) == "font")
        wanted = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("stylesheet", "icon", "apple-touch-icon", "manifest")])) | font
        one = lambda href, kind: F.array(F.struct(href.alias("href"), kind.alias("kind")))
        listed = F.filter(F.split(attribute(tag, "srcset"), ","), lambda p: F.trim(p) != "")
        from_set = F.transform(listed, lambda p: F.struct(F.substring_index(F.trim(p), " ", 1).alias("href"), F.lit("image").alias("kind")))
        link_kind = F.when(rel.contains("stylesheet"), "stylesheet").when(rel.contains("icon"), "image").otherwise("other")
        found = (
            F.when((name == "link") & wanted, one(attribute(tag, "href"), link_kind))
            .when(name == "img", F.concat(one(attribute(tag, "src"), F.lit("image")), from_set))
            .when(name == "source", F.concat(one(attribute(tag, "src"), F.lit("media")), from_set))
            .when(name == "video", one(attribute(tag, "poster"), F.lit("image")))
            .when(name.isin("iframe", "frame"), one(attribute(tag, "src"), F.lit("frame")))
            .when(name == "script", one(attribute(tag, "src"), F.lit("script")))
        )
        return F.filter(F.coalesce(found, F.expr("cast(array() as array<struct<href string, kind string>>)")), lambda r: r["href"] != "")

    return F.flatten(F.transform(F.regexp_extract_all(html, F.lit(RESOURCE_TAG), F.lit(0)), of_tag))


def without_credentials(html: Column) -> Column:
    """HTML whose password, hidden and sensitive fields have no values and whose sensitive text areas are empty."""
    inputs = F.regexp_replace(html, rf"(?is)<(input\b){_CLEARED}([^>]*?){VALUE}([^>]*)>", '<$1$2 value=""$3>')
    return F.regexp_replace(inputs, rf"(?is)(<textarea\b{_CLEARED}[^>]*>).*?(</textarea>)", "$1$2")
