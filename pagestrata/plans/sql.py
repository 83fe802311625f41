"""Pieces of DuckDB SQL that mirror the Column functions, for the registered queries' oracles."""

from __future__ import annotations

from pagestrata.functions import html, urls
from pagestrata.sources import views

STOP = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)


def scheme(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def host(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:@]*)', 1))"


def port(u: str) -> str:
    return rf"regexp_extract({u}, '^[A-Za-z]+://(?:[^/?#]*@)?[^/?#:@]*:([0-9]+)', 1)"


def path(u: str) -> str:
    return rf"coalesce(nullif(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def is_http(u: str) -> str:
    return rf"regexp_matches({u}, '(?i)^https?://[^/?#]+')"


def origin(u: str) -> str:
    plain = f"{port(u)} = '' OR ({scheme(u)} = 'http' AND {port(u)} = '80') OR ({scheme(u)} = 'https' AND {port(u)} = '443')"
    return f"({scheme(u)} || '://' || {host(u)} || CASE WHEN {plain} THEN '' ELSE ':' || {port(u)} END)"


def params(u: str) -> str:
    return f"list_filter(string_split({query(u)}, '&'), lambda p: p <> '')"


def joined(base: str, kept: str) -> str:
    return f"({base} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def escaped(text: str) -> str:
    """Characters outside of printable ASCII, and those that paths escape, as %XX of their UTF-8 bytes."""
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN regexp_matches(c, '[^!-~]|[\"#<>?^`{{}}]') THEN url_encode(c) ELSE c END), '')"


def normalize(u: str) -> str:
    kept = f"list_filter({params(u)}, lambda p: lower(string_split(p, '=')[1]) NOT IN ({STOP}))"
    ordered = f"list_transform(list_sort(list_transform({kept}, lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': p}})), lambda s: CASE WHEN contains(s.p, '=') THEN s.p ELSE s.p || '=' END)"
    p = f"CASE WHEN length({path(u)}) > 1 AND {path(u)} LIKE '%/' THEN regexp_replace({path(u)}, '/$', '') ELSE {path(u)} END"
    return f"CASE WHEN {is_http(u)} THEN {joined(f'{origin(u)} || {p}', ordered)} END"


def canonicalize(u: str) -> str:
    bare = f"regexp_replace({u}, '#.*$', '')"
    return rf"CASE WHEN NOT {is_http(u)} THEN {u} WHEN regexp_matches({bare}, '^[A-Za-z]+://[^/?#]*/?$') THEN {origin(u)} || '/' ELSE regexp_replace({bare}, '/$', '') END"


def thread_key(u: str) -> str:
    p = rf"coalesce(nullif(regexp_replace(regexp_replace({path(u)}, '(?i)/page/\d+(/|$)', '\1'), '/+$', ''), ''), '/')"
    kept = f"list_filter({params(u)}, lambda x: NOT regexp_matches(string_split(x, '=')[1], '{urls.PAGINATION_KEY}'))"
    return f"CASE WHEN {is_http(u)} THEN {joined(f'{origin(u)} || {p}', kept)} ELSE {u} END"


def extension(u: str) -> str:
    return rf"lower(regexp_extract(string_split({path(u)}, '/')[-1], '^.+\.([^.]*)$', 1))"


def shape(u: str, path_pattern: str | None, *query_patterns: str) -> str:
    parts = [f"regexp_matches({path(u)}, '{path_pattern}')"] if path_pattern else []
    return f"({is_http(u)} AND ({' OR '.join([*parts, *[f'regexp_matches({query(u)}, {chr(39)}{q}{chr(39)})' for q in query_patterns]])}))"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def attachment(u: str) -> str:
    return f"({is_http(u)} AND ({extension(u)} IN ({quoted(urls.DOCUMENT_EXTENSIONS)}) OR {shape(u, urls.ATTACHMENT_PATH, urls.ATTACHMENT_PARAM)}))"


def trap(u: str) -> str:
    seg = f"list_filter(string_split({path(u)}, '/'), lambda s: s <> '')"
    repeats = f"len(list_filter(list_distinct({seg}), lambda s: len(list_filter({seg}, lambda t: t = s)) >= {urls.MAX_SEGMENT_REPEATS})) > 0"
    dated = f"len(list_filter({params(u)}, lambda p: string_split(p, '=')[1] IN ({quoted(urls.DATE_PARAMS)}))) > 0"
    return f"(NOT {is_http(u)} OR len({params(u)}) > {urls.MAX_QUERY_KEYS} OR length({u}) > {urls.MAX_URL_CHARS} OR len({seg}) > {urls.MAX_SEGMENTS} OR {repeats} OR (regexp_matches({path(u)}, '{urls.CALENDAR_PATH}') AND {dated}))"


def title(h: str) -> str:
    return f"regexp_extract({h}, '(?is)<title>([^<]*)</title>', 1)"


def text(h: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({h}, '{html.DROPPED}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


ARCHIVES = f"""archives AS (SELECT page_id AS id, url AS final_url, {canonicalize('url')} AS canonical_url, {host('url')} AS domain, {title('html')} AS title, {text('html')} AS body,
  length(html) AS size_bytes, CASE WHEN url LIKE 'https%' THEN 'success' ELSE 'failed' END AS status,
  strftime(TIMESTAMP '2024-01-01' + to_hours(page_id), '%Y-%m-%dT%H:%M:%S.000Z') AS visited_at, url LIKE '%ref=%' AS deleted FROM pages)"""


def resolve(href: str, base: str) -> str:
    return rf"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN {href} LIKE '//%' THEN {scheme(base)} || ':' || {href}
  WHEN {href} LIKE '/%' THEN {origin(base)} || {href} WHEN {href} LIKE '?%' THEN regexp_replace({base}, '[?#].*$', '') || {href}
  WHEN {href} LIKE '#%' OR {href} = '' THEN regexp_replace({base}, '#.*$', '') || {href} ELSE {origin(base)} || regexp_replace({path(base)}, '[^/]*$', '') || {href} END"""


LINKS = f"""raw AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '{html.ANCHOR}', 1) AS hs FROM pages),
hrefs AS (SELECT page_id, page_url, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM raw),
links AS (SELECT *, {resolve('href', 'page_url')} AS url FROM hrefs)"""

JOURNAL = """journal AS (SELECT user_id AS archive_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'enq' WHEN 'click' THEN 'deq' WHEN 'purchase' THEN 'page' WHEN 'error' THEN 'failure' ELSE 'stat' END AS t,
  json_extract_string(props, '$.k') AS norm, ts, value FROM events)"""


DECORATED = f"decorated AS (SELECT page_id, url, html || replace('{views.EXTRA}', '{{id}}', CAST(page_id AS VARCHAR)) AS html FROM pages)"

ANCHORS = rf"""{DECORATED}, outer_pieces AS (SELECT page_id, url AS page_url, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT *, string_split(html, '</form>') AS ps FROM decorated)),
inner_pieces AS (SELECT page_id, page_url, i, unnest(ps) AS piece, generate_subscripts(ps, 1) AS j FROM (SELECT *, string_split(piece, '<form') AS ps FROM outer_pieces)),
tags AS (SELECT page_id, page_url, i, j, unnest(ts) AS whole, generate_subscripts(ts, 1) AS k FROM (SELECT *, regexp_extract_all(piece, '(?is)<a\s[^>]*>.*?</a>') AS ts FROM inner_pieces)),
parts AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, j, k) - 1 AS pos, regexp_extract(whole, '(?is)^<a\s[^>]*>') AS tag FROM tags),
plain AS (SELECT page_id, page_url, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(whole, '<[^>]*>', '', 'g'))[1:200] AS text,
  regexp_extract(tag, 'rel="([^"]*)"', 1) AS rel, regexp_matches(tag, '\sdownload[\s=>/]') AS download, j > 1 AS in_form FROM parts),
anchors AS (SELECT *, {resolve('href', 'page_url')} AS url FROM plain WHERE href <> '')"""


def decision(u: str, page: str) -> str:
    return f"""CASE WHEN NOT {is_http(u)} THEN 'drop' WHEN {shape(u, urls.DESTRUCTIVE_PATH, urls.DESTRUCTIVE_PARAM)} THEN 'skipped-sensitive'
  WHEN {origin(u)} <> {origin(page)} THEN 'drop' WHEN {shape(u, urls.PRINT_PATH, urls.PRINT_PARAM)} THEN 'skipped-duplicate'
  WHEN {trap(u)} THEN 'skipped-trap' WHEN {shape(u, urls.NON_CONTENT_PATH, urls.NON_CONTENT_PARAM)} THEN 'skipped-non-content' ELSE 'enqueue' END"""


def search(docs: str, words: list[str], weights: dict[str, int]) -> str:
    """SELECT of id and score over a relation docs."""
    tok = lambda c: rf"list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    split = ", ".join(f"{tok(c)} AS t_{c}" for c in weights)
    dl = " + ".join(f"len(t_{c})" for c in weights)
    tf = [" + ".join(f"{n} * len(list_filter(t_{c}, lambda t: starts_with(t, '{w}')))" for c, n in weights.items()) for w in words]
    counted = ", ".join(f"CAST({t} AS DOUBLE) AS tf{i}" for i, t in enumerate(tf))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = "".join(f" - greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(words)))
    match = " AND ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""split AS (SELECT *, {split} FROM {docs}), counted AS (SELECT *, {dl} AS dl, {counted} FROM split),
stats AS (SELECT count(*) AS n, avg(dl) AS av, {stats} FROM counted),
found AS (SELECT counted.*, 0.0{score} AS score FROM counted, stats WHERE {match})"""


def has_prefix(c: str, prefix: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: starts_with(t, '{prefix}'))) > 0"


def snippet(c: str, prefix: str, width: int, before: str = "", after: str = "") -> str:
    """The first window of width words of column c that starts at a hit, hits marked."""
    marks = [f"chr({ord(m)})" if m else "''" for m in (before, after)]
    return rf"""(WITH w AS (SELECT list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '') AS ws), a AS (SELECT ws, coalesce(list_filter(list_transform(ws, lambda x, i: CASE WHEN {has_prefix('x', prefix)} THEN i END), lambda i: i IS NOT NULL)[1], 1) AS s FROM w)
  SELECT CASE WHEN s > 1 THEN '…' ELSE '' END || array_to_string(list_transform(ws[s:s + {width} - 1], lambda x: CASE WHEN {has_prefix('x', prefix)} THEN {marks[0]} || x || {marks[1]} ELSE x END), ' ') || CASE WHEN len(ws) > s - 1 + {width} THEN '…' ELSE '' END FROM a)"""


def windows(rows: str, key: str, c: str, phrases: list[list[str]], width: int, before: str = "", after: str = "") -> str:
    """CTEs up to windows(key, n_phrases, snippet): the window of width words of column c of rows that holds most phrases, of one or two tokens, marked whole."""
    found = []
    for n, (first, *rest) in enumerate(phrases):
        here = f"tok = '{first}' AND starts_with(tok2, '{rest[0]}')" if rest else f"starts_with(tok, '{first}')"
        found.append(f"SELECT DISTINCT k, {n} AS phrase, i AS a, {'i2' if rest else 'i'} AS b FROM w_pairs WHERE {here}")
    return rf"""w_texts AS (SELECT {key} AS k, list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '') AS ws FROM {rows}),
w_words AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w_texts),
w_split AS (SELECT k, i, list_filter(regexp_split_to_array(lower(strip_accents(word)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ts FROM w_words),
w_tokens AS (SELECT k, i, unnest(ts) AS tok, generate_subscripts(ts, 1) AS n FROM w_split),
w_pairs AS (SELECT k, i, tok, lead(tok) OVER o AS tok2, lead(i) OVER o AS i2 FROM w_tokens WINDOW o AS (PARTITION BY k ORDER BY i, n)),
w_hits AS ({' UNION ALL '.join(found)}),
w_counts AS (SELECT x.k, x.a AS start, count(DISTINCT y.phrase) AS n FROM w_hits x JOIN w_hits y ON y.k = x.k AND y.a >= x.a AND y.a < x.a + {width} AND (y.b < x.a + {width} OR y.a = x.a) GROUP BY ALL),
w_best AS (SELECT k, arg_max(start, (n, -start)) AS start, max(n) AS n FROM w_counts GROUP BY k),
w_inside AS (SELECT b.k, h.a, h.b FROM w_best b JOIN w_hits h ON h.k = b.k AND h.a >= start AND h.a < start + {width} AND (h.b < start + {width} OR h.a = start)),
w_shown AS (SELECT w.k, w.i, w.word, start, b.n, bool_or(x.a <= w.i AND w.i <= x.b) AS held, bool_or(x.a < w.i AND w.i <= x.b AND w.i > start) AS joined, bool_or(x.a <= w.i AND w.i < x.b AND w.i < start + {width} - 1) AS goes_on
  FROM w_best b JOIN w_words w ON w.k = b.k AND w.i >= start AND w.i < start + {width} JOIN w_inside x ON x.k = b.k GROUP BY w.k, w.i, w.word, start, b.n),
windows AS (SELECT s.k AS {key}, any_value(s.n) AS n_phrases, CASE WHEN any_value(start) > 0 THEN '…' ELSE '' END || string_agg(CASE WHEN held AND NOT joined THEN '{before}' ELSE '' END || word || CASE WHEN held AND NOT goes_on THEN '{after}' ELSE '' END, ' ' ORDER BY i)
  || CASE WHEN any_value(len(t.ws)) > any_value(start) + {width} THEN '…' ELSE '' END AS snippet FROM w_shown s JOIN w_texts t ON t.k = s.k GROUP BY s.k)"""
