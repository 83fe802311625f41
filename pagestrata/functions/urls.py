"""URL algebra as Column expressions: parts, identities, keys and shape predicates.

Well-formed absolute URLs are read by regular expressions inside code generation;
null or unparsable input gives null parts, and each predicate states what it gives then.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.functions.url_standard import cleaned, let, standard

# Parameters that never change what a URL returns.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform",
    "gclid", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref_src", "ref_url",
    "_ga", "_gl", "yclid", "twclid", "ttclid", "si",
)
# Patterns of URL shapes, and extensions by class.
DESTRUCTIVE_PATH = r"(?i)/(logout|log-out|signout|sign-out|delete|remove|destroy|unsubscribe|reset|revoke|deactivate|purge|wipe|admin/delete)(/|$|\?)"
DESTRUCTIVE_PARAM = r"(?i)\b(action|do|op|cmd)=(delete|remove|destroy|logout|signout|reset|purge)\b"
NON_CONTENT_PATH = r"(?i)(^|/)(login|log-in|signin|sign-in|register|signup|sign-up|lostpassword|lost-password|forgot-password|search|members|member|profile|profiles|account|preferences|new-thread|create-thread|post-thread|new-topic|reply|subscribe|watched|bookmarks|conversations|notifications|cart|checkout)(/|$)"
NON_CONTENT_PARAM = r"(?i)\b(do|action|mode|view)=(login|register|search|newthread|newreply|profile|account)\b"
PROFILE_WORDS = "members|member|profile|profiles|"
PAGINATION_PATH = r"(?i)/page/(\d+)(/|$)"
PAGINATION_PARAM = r"(?i)\b(page|pg|p)=(\d+)\b"
PAGINATION_OFFSET = r"(?i)\b(start|offset)=(\d+)\b"
PAGINATION_TEXT = r"(?i)^(next|prev(ious)?|»|«|›|‹|\d{1,4})$"
PAGINATION_KEY = r"(?i)^(page|pg|p|start|offset)$"
ATTACHMENT_PATH = r"(?i)/(attachments?|download|files?)/"
ATTACHMENT_PARAM = r"(?i)\b(attachmentid|attach|fileid|downloadid)="
AVATAR_PATH = r"(?i)/(avatars?|customavatars|emoji|emoticons?|smilies|smileys)/"
PRINT_PARAM = r"(?i)\b(mode|view|do)=print\b"
PRINT_PATH = r"(?i)/(print|printthread|printpage)(/|\.|$)"
CALENDAR_PATH = r"(?i)/(calendar|events?|schedule|archive)/"
DATE_PARAMS = ("year", "month", "day", "date", "week", "from", "to")
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "csv", "txt", "zip")
MEDIA_EXTENSIONS = ("mp4", "webm", "mov", "avi", "mkv", "m4v", "mp3", "wav", "ogg", "oga", "flac", "aac", "m4a")
EXECUTABLE_EXTENSIONS = ("exe", "msi", "bat", "cmd", "com", "scr", "ps1", "vbs", "jar", "app", "dmg", "pkg", "sh", "bash", "zsh", "run", "bin", "deb", "rpm", "apk")
MAX_QUERY_KEYS, MAX_URL_CHARS, MAX_SEGMENTS, MAX_SEGMENT_REPEATS = 12, 2000, 20, 4


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:@]*)", 1))


def user_info(url: Column) -> Column:
    """What stands before the host, with its @."""
    return F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*@)", 1)


def port(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#]*@)?[^/?#:@]*:([0-9]+)", 1)


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def non_default_port(url: Column) -> Column:
    p, s = port(url), scheme(url)
    return F.when((p == "") | ((s == "http") & (p == "80")) | ((s == "https") & (p == "443")), "").otherwise(F.concat(F.lit(":"), p))


def origin(url: Column) -> Column:
    return F.when(is_http(url), F.concat(scheme(url), F.lit("://"), host(url), non_default_port(url)))


def params(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def param_key(p: Column) -> Column:
    return F.substring_index(p, "=", 1)


def _join_query(base: Column, kept: Column) -> Column:
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _decoded(part: Column) -> Column:
    """A part of a query as form data; one with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(part), part)


def normalize(url: Column) -> Column:
    """Crawl identity: no tracking parameters, the rest written as form data in stable order of key, no fragment, no trailing slash; null unless http(s)."""
    keyed = F.transform(params(url), lambda p, i: F.struct(_decoded(param_key(p)).alias("k"), i.alias("i"), _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(keyed, lambda s: ~F.lower(s["k"]).isin(*TRACKING_PARAMS))
    ordered = F.transform(F.array_sort(kept), lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"])))
    p = path(url)
    p = F.when((F.char_length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    start = F.concat(scheme(url), F.lit("://"), user_info(url), host(url), non_default_port(url))
    return F.when(is_http(url), _join_query(F.concat(start, p), ordered))


def _form_decoded(part: Column) -> Column:
    """A part of a query as form data; broken escapes stay as they are."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _identity(url: Column) -> Column:
    keyed = F.transform(params(url), lambda p, i: F.struct(_form_decoded(param_key(p)).alias("k"), i.alias("i"), _form_decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(keyed, lambda s: ~F.lower(s["k"]).isin(*TRACKING_PARAMS))
    ordered = F.transform(F.array_sort(kept), lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"])))
    place = F.regexp_extract(url, r"^[^?#]*", 0)
    return _join_query(F.regexp_replace(place, "^([^/]*//[^/]*/.*)/$", "$1"), ordered)


def normalize_standard(url: Column) -> Column:
    """Crawl identity: the URL as the standard writes it, no tracking parameters, the rest written as form data in stable order of key, no fragment, no trailing slash; null unless http(s)."""
    return let(standard(url), _identity)


def canonicalize(url: Column) -> Column:
    """Catalog identity: no fragment and no trailing slash but the root's; other input stays as it is."""
    bare = F.regexp_replace(url, r"#.*$", "")
    rooted = bare.rlike(r"^[A-Za-z]+://[^/?#]*/?$")
    return F.when(is_http(url), F.when(rooted, F.concat(origin(url), F.lit("/"))).otherwise(F.regexp_replace(bare, "/$", ""))).otherwise(url)


def thread_key(url: Column) -> Column:
    """The URL without its first page number in the path, and without those in parameters."""
    p = F.regexp_replace(F.regexp_replace(path(url), r"(?i)^(.*?)/page/\d+(/.*|)$", "$1$2"), "/+$", "")
    kept = F.filter(params(url), lambda x: ~param_key(x).rlike(PAGINATION_KEY))
    return F.when(is_http(url), _join_query(F.concat(origin(url), F.when(p == "", "/").otherwise(p)), kept)).otherwise(url)


def extension(url: Column) -> Column:
    base = F.substring_index(path(url), "/", -1)
    return F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))


def leading_segment(url: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(0)), F.lit(""))


def redact(url: Column) -> Column:
    """Scheme, host and port other than the default; a mark in place of what is no http URL."""
    return F.when(is_http(url), origin(url)).otherwise("[unparsable-url]")


def in_scope(url: Column, start: Column, domains: Sequence[str] = ()) -> Column:
    """Same origin as start, or the host or a subdomain of one of domains."""
    h = host(url)
    under = [(h == d) | h.endswith("." + d) for d in domains]
    return is_http(url) & reduce(lambda a, b: a | b, under, origin(url) == origin(start))


def same_host_or_under(url: Column, base: Column) -> Column:
    return (host(url) == base) | host(url).endswith(F.concat(F.lit("."), base))


def is_safe_remote(url: Column) -> Column:
    """http(s) only."""
    return scheme(url).isin("http", "https")


def is_safe_external(url: Column) -> Column:
    """What may be handed to other programs: http(s) and mail addresses."""
    return scheme(url).isin("http", "https", "mailto")


def looks_destructive(url: Column) -> Column:
    return is_http(url) & (path(url).rlike(DESTRUCTIVE_PATH) | query(url).rlike(DESTRUCTIVE_PARAM))


def looks_non_content(url: Column, include_profiles: bool = False, allowed_paths: Sequence[str] = ()) -> Column:
    p, q = (NON_CONTENT_PATH.replace(PROFILE_WORDS, ""), NON_CONTENT_PARAM.replace("profile|", "")) if include_profiles else (NON_CONTENT_PATH, NON_CONTENT_PARAM)
    let = [F.lower(path(url)).contains(a.strip().lower()) for a in allowed_paths if a.strip()]
    return is_http(url) & ~reduce(lambda a, b: a | b, let, F.lit(False)) & (path(url).rlike(p) | query(url).rlike(q))


def looks_trap(url: Column) -> Column:
    """Signs of generated URLs; input that is no URL counts as one."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    repeats = F.exists(F.array_distinct(segments), lambda s: F.size(F.filter(segments, lambda t: t == s)) >= MAX_SEGMENT_REPEATS)
    dated = F.exists(params(url), lambda p: param_key(p).isin(*DATE_PARAMS))
    return (
        ~is_http(url)
        | (F.size(params(url)) > MAX_QUERY_KEYS)
        | (F.char_length(url) > MAX_URL_CHARS)
        | (F.size(segments) > MAX_SEGMENTS)
        | repeats
        | (path(url).rlike(CALENDAR_PATH) & dated)
    )


def looks_pagination(url: Column, text: Column | None = None) -> Column:
    by_url = path(url).rlike(PAGINATION_PATH) | query(url).rlike(PAGINATION_PARAM) | query(url).rlike(PAGINATION_OFFSET)
    by_text = F.coalesce(F.trim(text).rlike(PAGINATION_TEXT), F.lit(False)) if text is not None else F.lit(False)
    return is_http(url) & (by_url | by_text)


def is_document(url: Column) -> Column:
    return extension(url).isin(*DOCUMENT_EXTENSIONS)


def is_media(url: Column) -> Column:
    return extension(url).isin(*MEDIA_EXTENSIONS)


def looks_attachment(url: Column) -> Column:
    return is_http(url) & (extension(url).isin(*DOCUMENT_EXTENSIONS) | path(url).rlike(ATTACHMENT_PATH) | query(url).rlike(ATTACHMENT_PARAM))


def looks_avatar(url: Column) -> Column:
    return is_http(url) & path(url).rlike(AVATAR_PATH)


def looks_print_view(url: Column) -> Column:
    return is_http(url) & (query(url).rlike(PRINT_PARAM) | path(url).rlike(PRINT_PATH))


def without_dots(url: Column) -> Column:
    """url with the steps . and .. of its path taken; steps above the root stay there."""
    segments = F.split(path(url), "/")

    def step(taken: Column, segment: Column) -> Column:
        up = F.slice(taken, 1, F.greatest(F.size(taken) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", taken).otherwise(F.array_append(taken, segment))

    taken = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), step)
    ends = F.when(path(url).rlike(r"/\.\.?$") & (F.size(taken) > 0), "/").otherwise("")
    head, tail = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(url, r"([?#].*)$", 1)
    return F.when(path(url).rlike(r"/\.\.?(/|$)"), F.concat(head, F.lit("/"), F.array_join(taken, "/"), ends, tail)).otherwise(url)


def resolve(href: Column, base: Column) -> Column:
    """href against base: absolute, //host, /path, ?query, #fragment and relative paths, with steps of dots taken."""
    return without_dots(_resolved(href, base))


def resolve_standard(href: Column, base: Column) -> Column:
    """href against base as a browser follows it, by the standard; null where that is no http(s) URL."""
    start = let(standard(base), lambda b: F.regexp_replace(b, "#.*$", ""))
    return let(let(start, lambda b: let(cleaned(href), lambda h: _resolved(h, b))), standard)


def _resolved(href: Column, base: Column) -> Column:
    bare = F.regexp_replace(base, r"[?#].*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(origin(base), F.regexp_replace(path(base), r"[^/]*$", ""), href))
    )
