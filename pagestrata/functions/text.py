"""Small string functions as Column expressions: match queries, snippets, escapes, sizes, names and address-bar input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_MARK, END_MARK = "\u0001", "\u0002"
# Characters that names can't hold, and what passes for a bare domain.
UNSAFE_IN_NAMES = r'[/\\?%*:|"<>]'
BARE_DOMAIN = r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(:\d+)?(/.*)?$"
# URLs and content types that signal credentials.
SENSITIVE_URL = r"(?i)(/oauth/|/token\b|/session\b|/login\b|/signin\b|/auth\b|/credential|/secret|/apikey|/api[-_]key|\.pem$|\.key$|\.p12$|\.pfx$|/logout\b)"
CREDENTIAL_TYPES = ("application/x-pkcs12", "application/x-pem-file", "application/pkcs8", "application/x-x509-ca-cert", "application/jwt")


def match_query(words: Column) -> Column:
    """Each word quoted and made a prefix; inner quotes doubled; blank input gives an empty query."""
    found = F.filter(F.split(words, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(found, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"*'))), " ")


def snippet_parts(snippet: Column) -> Column:
    """A marked snippet as alternating plain and matched parts, plain first."""
    return F.split(snippet, f"[{START_MARK}{END_MARK}]")


def escaped(text: Column) -> Column:
    """Text for HTML bodies and double-quoted attributes."""
    out = text
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def file_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one decimal from KB on."""
    unit = lambda k, name: F.concat(F.format_string("%.1f", F.round(n / (1 << k), 1)), F.lit(name))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(10, " KB")).when(n < 1 << 30, unit(20, " MB")).otherwise(unit(30, " GB"))


def archive_filename(title: Column, host: Column, suffix: str = ".archive.zip") -> Column:
    """A file name of a title, or of the host where the title is empty."""
    base = F.when(F.coalesce(title, F.lit("")) == "", F.when(host == "", "website").otherwise(host)).otherwise(title)
    short = F.substring(F.trim(F.regexp_replace(base, UNSAFE_IN_NAMES, "-")), 1, 80)
    return F.concat(F.when(short == "", host).otherwise(short), F.lit(suffix))


def component(text: Column) -> Column:
    """Text as a component of a URL."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def address(typed: Column, template: str) -> Column:
    """Where an address bar goes: nothing, a URL, a bare domain by https, or a search with %s as the place of the words."""
    t = F.trim(typed)
    words = component(t)
    before, place, after = template.partition("%s")
    found = F.concat(F.lit(before), words, F.lit(after if place else ""))
    return F.when(t == "", "about:blank").when(t.rlike(r"(?i)^https?://[^/?#\s]+"), t).when(t.rlike(BARE_DOMAIN) & ~t.contains(" "), F.concat(F.lit("https://"), t)).otherwise(found)


def is_sensitive_url(url: Column) -> Column:
    return F.coalesce(url.rlike(SENSITIVE_URL), F.lit(False))


def is_credential_type(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(*CREDENTIAL_TYPES), F.lit(False))
