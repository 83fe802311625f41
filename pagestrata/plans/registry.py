"""Registered queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import forms, html, text, urls
from pagestrata.operators import budget, catalog, container, crawl, forum, journal, search
from pagestrata.operators.scans import numbered
from pagestrata.plans import indexes, sql
from pagestrata.sources import journal_log, views, zips
from pagestrata.sources.tables import new_path, settle
from pagestrata.streaming import visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BOTH_WORDS = ["th", "on"]
QUOTA_SHARE = 0.9
RETENTION = "1995-04-01"
ROBOTS_RULES = [("/en", False), ("/en/", False), ("/en/7", True), ("/fr", False), ("/fr", True), ("", False)]
ROBOTS_LINES = ["User-agent: other", "Disallow: /", "", "User-agent: *", "Disallow: /de # all", "Allow: /de/5", "User-agent: last", "Disallow: /es"]
EXCLUDED = ("example.net", "spam-farm.example.org")


def register(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.archives(spark, sf_dir).where(~F.col("deleted"))


# Catalog

LIBRARY = catalog.LibraryQuery(status="success", date_from="2024-01-01T05:00:00.000Z", date_to="2024-12-31T00:00:00.000Z", sort="newest")
LIBRARY_WHERE = "NOT deleted AND status = 'success' AND visited_at >= '2024-01-01T05:00:00.000Z' AND visited_at <= '2024-12-31T00:00:00.000Z'"


@register(f"WITH {sql.ARCHIVES} SELECT id, canonical_url, title, domain, visited_at, size_bytes FROM archives WHERE {LIBRARY_WHERE} ORDER BY visited_at DESC, id LIMIT 50")
def library_filter_sort_page(spark, sf_dir):
    """PF-04/05, SL-01/03: a page of the library."""
    return LIBRARY.page(views.archives(spark, sf_dir)).select("id", "canonical_url", "title", "domain", "visited_at", "size_bytes")


@register(f"WITH {sql.ARCHIVES} SELECT count(*) AS total FROM archives WHERE {LIBRARY_WHERE}")
def library_total(spark, sf_dir):
    """AG-01: the count under the same filters."""
    return LIBRARY.filtered(views.archives(spark, sf_dir)).agg(F.count("*").alias("total"))


@register(f"WITH {sql.ARCHIVES} SELECT id, canonical_url, count(*) OVER (PARTITION BY canonical_url) AS n_versions, CAST(row_number() OVER (PARTITION BY canonical_url ORDER BY visited_at DESC, id) AS INTEGER) AS place FROM archives WHERE NOT deleted")
def library_versions(spark, sf_dir):
    """AG-02, SL-05: versions of each page, newest first."""
    return catalog.versions(views.archives(spark, sf_dir))


@register(f"WITH {sql.ARCHIVES} SELECT canonical_url, arg_max(id, (visited_at, id)) AS id, max(visited_at) AS visited_at FROM archives WHERE NOT deleted AND status = 'success' GROUP BY canonical_url")
def library_latest_success(spark, sf_dir):
    """WN-04: the latest successful version."""
    return catalog.latest_success(views.archives(spark, sf_dir))


@register(f"WITH {sql.ARCHIVES} SELECT DISTINCT domain FROM archives WHERE NOT deleted")
def library_domains(spark, sf_dir):
    """AG-05: distinct domains."""
    return active(spark, sf_dir).select("domain").distinct()


@register(f"WITH {sql.ARCHIVES} SELECT count(*) AS n_archives, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM archives WHERE NOT deleted")
def library_usage(spark, sf_dir):
    """AG-03/04: count and bytes of active rows."""
    return catalog.usage(views.archives(spark, sf_dir))


@register(f"WITH {sql.ARCHIVES} SELECT domain, count(*) AS n_deleted FROM archives WHERE NOT deleted GROUP BY domain")
def library_delete_by_domain(spark, sf_dir):
    """DM-04/05, PF-07: what deletion by domain removes, for every domain."""
    return active(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n_deleted"))


@register(f"WITH {sql.ARCHIVES} SELECT id, domain, domain = 'example.net' OR domain LIKE '%.example.net' OR domain = 'spam-farm.example.org' OR domain LIKE '%.spam-farm.example.org' AS excluded FROM archives")
def library_excluded_domains(spark, sf_dir):
    """PF-09: domains excluded by equality or suffix."""
    d = F.col("domain")
    hit = F.lit(False)
    for x in EXCLUDED:
        hit = hit | (d == x) | d.endswith("." + x)
    return views.archives(spark, sf_dir).select("id", "domain", hit.alias("excluded"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("visited_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))


SIZED = "sized AS (SELECT o_orderkey AS id, o_orderdate AS visited_at, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders)"


@register(f"WITH {SIZED}, old AS (SELECT * FROM sized ORDER BY visited_at, id LIMIT 10000) SELECT id, visited_at, size FROM old WHERE visited_at < TIMESTAMP '{RETENTION}'")
def retention(spark, sf_dir):
    """DM-09, SL-04: items beyond retention among the oldest 10,000."""
    return catalog.beyond_retention(sized(spark, sf_dir), F.lit(RETENTION).cast("timestamp_ntz"))


@register(f"""WITH {SIZED}, tot AS (SELECT sum(size) AS total FROM sized), old AS (SELECT * FROM sized ORDER BY visited_at, id LIMIT 10000),
freed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY visited_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM old)
SELECT id, visited_at, size FROM freed, tot WHERE total - freed > CAST({QUOTA_SHARE} * total AS BIGINT)""")
def quota_evict(spark, sf_dir):
    """DM-10, WN-03: oldest items evicted until the rest fits a quota of nine tenths."""
    items = sized(spark, sf_dir)
    total = items.agg(F.round(F.sum("size") * F.lit(QUOTA_SHARE)).cast("long").alias("q")).first()["q"] or 0
    return catalog.beyond_quota(items, total)


@register("""WITH blobs AS (SELECT doc_id AS id, text AS content, CASE WHEN n_chars > 1000 THEN sha256(text) WHEN n_chars > 500 THEN 'x' END AS expected FROM documents),
known AS (SELECT DISTINCT doc_id AS id FROM labels)
SELECT b.id, CASE WHEN k.id IS NOT NULL THEN 'skipped' WHEN expected IS NOT NULL AND expected <> sha256(content) THEN 'failed' ELSE 'imported' END AS outcome FROM blobs b LEFT JOIN known k ON b.id = k.id""")
def import_antijoin(spark, sf_dir):
    """JN-07, DM-11, AG-15: outcomes of an idempotent import with verified hashes."""
    docs = views.table(spark, sf_dir, "documents")
    expected = F.when(F.col("n_chars") > 1000, F.sha2("text", 256)).when(F.col("n_chars") > 500, "x")
    incoming = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), expected.alias("expected_sha256"))
    return catalog.import_new(incoming, views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@register("SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def history_upsert(spark, sf_dir):
    """DM-06/07: last write wins."""
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value")
    return catalog.upsert_last(rows, "key", "seq")


# Search

PAGE_WEIGHTS = {"title": 2, "final_url": 1, "domain": 1, "body": 1}
ACTIVE = "active AS (SELECT * FROM archives WHERE NOT deleted)"


@register(f"WITH {sql.ARCHIVES}, {ACTIVE}, {sql.search('active', BOTH_WORDS, PAGE_WEIGHTS)} SELECT id, domain, title, round(score, 6) AS score FROM found")
def fts_bm25_weighted(spark, sf_dir):
    """FT-01..04, JN-01: every match of two prefixes with its weighted score."""
    rows = active(spark, sf_dir)
    found = rows.select("id", "domain", "title").join(indexes.library(rows).search(" ".join(BOTH_WORDS), PAGE_WEIGHTS), "id")
    return found.select("id", "domain", "title", F.round("score", 6).alias("score"))


@register(f"WITH {sql.ARCHIVES}, {ACTIVE}, {sql.search('active', BOTH_WORDS, PAGE_WEIGHTS)} SELECT id, round(score, 6) AS score FROM found WHERE status = 'success' ORDER BY round(score, 6), id LIMIT 50")
def fts_filtered_page(spark, sf_dir):
    """FT-04, SL-02: filters after scoring; statistics cover every active document."""
    rows = active(spark, sf_dir)
    found = rows.where("status = 'success'").select("id").join(indexes.library(rows).search(" ".join(BOTH_WORDS), PAGE_WEIGHTS), "id")
    return found.select("id", F.round("score", 6).alias("score")).orderBy("score", "id").limit(50)


@register(f"WITH docs AS (SELECT doc_id AS id, text AS body FROM documents), {sql.search('docs', ['thin', 're'], {'body': 1})} SELECT id, round(score, 6) AS score FROM found ORDER BY round(score, 6), id LIMIT 30")
def fts_top30(spark, sf_dir):
    """FT-05, SL-07: the 30 best documents by unweighted rank."""
    found = indexes.documents(views.table(spark, sf_dir, "documents")).search("thin re")
    return found.select("id", F.round("score", 6).alias("score")).orderBy("score", "id").limit(30)


@register(f"WITH posts AS (SELECT conv_id, turn, role AS author, text AS body FROM conversations), {sql.search('posts', ['assist', 'en'], {'author': 1, 'body': 1})} SELECT conv_id AS thread_key, turn AS post_number, author, round(score, 6) AS score FROM found")
def post_search(spark, sf_dir):
    """FT-05, JN-03: posts by author and body."""
    rows = views.posts(spark, sf_dir)
    found = rows.drop("body").join(indexes.posts(rows).search("assist en"), ["thread_key", "post_number"])
    return found.select("thread_key", "post_number", "author", F.round("score", 6).alias("score"))


@register(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM documents),
g AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_hits FROM g GROUP BY term""")
def fts_postings(spark, sf_dir):
    """FT-02/09: term statistics of the index."""
    return indexes.documents(views.table(spark, sf_dir, "documents")).terms()


@register(f"WITH {sql.ARCHIVES} SELECT id, {sql.snippet('body', 'then', 10, chr(1), chr(2))} AS snippet FROM archives WHERE NOT deleted AND {sql.has_prefix('body', 'then')}")
def fts_snippet(spark, sf_dir):
    """FT-06/07: snippets of matching pages."""
    rows = active(spark, sf_dir)
    found = rows.join(indexes.library(rows).matches("then", {"body": 1}), "id", "left_semi")
    return found.select("id", search.snippet(F.col("body"), ["then"]).alias("snippet"))


# URLs


@register(f"SELECT page_id, {sql.normalize('url')} AS normalized, {sql.canonicalize('url')} AS canonical, {sql.thread_key('url')} AS thread_key FROM pages")
def url_identities(spark, sf_dir):
    """SC-U01/02/07: the identities of a URL."""
    return views.table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized"), urls.canonicalize(F.col("url")).alias("canonical"), urls.thread_key(F.col("url")).alias("thread_key"))


@register(rf"""SELECT page_id, {sql.host('url')} AS domain, {sql.origin('url')} AS origin, regexp_extract(url, '#(.*)$', 1) AS fragment, {sql.extension('url')} AS ext,
coalesce(list_filter(string_split({sql.path('url')}, '/'), lambda s: s <> '')[1], '') AS lead, {sql.scheme('url')} || '://' || {sql.host('url')} AS redacted FROM pages""")
def url_parts(spark, sf_dir):
    """SC-U03/04/05/08/09/12: the parts of a URL."""
    return views.table(spark, sf_dir, "pages").select(
        "page_id", urls.host(F.col("url")).alias("domain"), urls.origin(F.col("url")).alias("origin"), urls.fragment(F.col("url")).alias("fragment"), urls.extension(F.col("url")).alias("ext"), urls.leading_segment(F.col("url")).alias("lead"), urls.redact(F.col("url")).alias("redacted")
    )


@register(f"""WITH u AS (SELECT url FROM pages UNION ALL SELECT * FROM (WITH {sql.LINKS} SELECT url FROM links)), d AS (SELECT DISTINCT url FROM u)
SELECT url, {sql.shape('url', urls.DESTRUCTIVE_PATH, urls.DESTRUCTIVE_PARAM)} AS destructive, {sql.shape('url', urls.NON_CONTENT_PATH, urls.NON_CONTENT_PARAM)} AS non_content, {sql.trap('url')} AS trap,
{sql.shape('url', urls.PAGINATION_PATH, urls.PAGINATION_PARAM, urls.PAGINATION_OFFSET)} AS pagination, {sql.attachment('url')} AS attachment, {sql.shape('url', urls.AVATAR_PATH)} AS avatar,
{sql.shape('url', urls.PRINT_PATH, urls.PRINT_PARAM)} AS print_view, {sql.extension('url')} IN ({sql.quoted(urls.MEDIA_EXTENSIONS)}) AS media, {sql.extension('url')} IN ({sql.quoted(urls.EXECUTABLE_EXTENSIONS)}) AS executable FROM d""")
def url_shapes(spark, sf_dir):
    """PF-13..19, PF-21: the shape predicates over every page and link URL."""
    every = views.table(spark, sf_dir, "pages").select("url").union(views.links(spark, sf_dir).select("url")).distinct()
    return every.select(
        "url",
        urls.looks_destructive(F.col("url")).alias("destructive"),
        urls.looks_non_content(F.col("url")).alias("non_content"),
        urls.looks_trap(F.col("url")).alias("trap"),
        urls.looks_pagination(F.col("url")).alias("pagination"),
        urls.looks_attachment(F.col("url")).alias("attachment"),
        urls.looks_avatar(F.col("url")).alias("avatar"),
        urls.looks_print_view(F.col("url")).alias("print_view"),
        urls.extension(F.col("url")).isin(*urls.MEDIA_EXTENSIONS).alias("media"),
        urls.extension(F.col("url")).isin(*urls.EXECUTABLE_EXTENSIONS).alias("executable"),
    )


@register(f"SELECT page_id, {sql.origin('url')} = 'https://m.ththth.example.net' OR {sql.host('url')} = 'example.com' OR {sql.host('url')} LIKE '%.example.com' AS in_scope FROM pages")
def url_scope(spark, sf_dir):
    """PF-11/12, JN-21: same origin or an allowed domain."""
    return views.table(spark, sf_dir, "pages").select("page_id", urls.in_scope(F.col("url"), F.lit("https://m.ththth.example.net/"), ("example.com",)).alias("in_scope"))


@register(f"""WITH r(rule, allow) AS (VALUES {', '.join(f"('{a}', {str(b).lower()})" for a, b in ROBOTS_RULES)}), p AS (SELECT DISTINCT {sql.path('url')} AS path FROM pages)
SELECT path, coalesce(arg_max(allow, (length(rule), allow)), true) AS allowed FROM p LEFT JOIN r ON starts_with(path, rule) AND rule <> '' GROUP BY path""")
def robots_longest_match(spark, sf_dir):
    """JN-20, PF-20: the longest matching rule."""
    rules = spark.createDataFrame(ROBOTS_RULES, "rule string, allow boolean")
    return crawl.robots_allowed(views.table(spark, sf_dir, "pages").select(urls.path(F.col("url")).alias("path")).distinct(), rules)


@register(f"""SELECT {sql.host('url')} AS host, {sql.path('url')} AS path, length({sql.host('url')}) % 2 = 1 OR {sql.path('url')} LIKE '/de/5%' OR {sql.path('url')} NOT LIKE '/de%' AS allowed FROM pages GROUP BY ALL""")
def robots_parsed(spark, sf_dir):
    """UD-10, SRC-16: robots files of half of the hosts parsed from their lines; hosts without a file allow everything."""
    paths = views.table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")).distinct()
    hosts = paths.select("host").distinct().where(F.length("host") % 2 == 0)
    lines = hosts.select("host", F.posexplode(F.array(*[F.lit(x) for x in ROBOTS_LINES])).alias("line_no", "line"))
    return crawl.robots_allowed(paths, crawl.parse_robots(lines))


# HTML and crawl

@register(f"SELECT page_id, {sql.title('html')} AS title, {sql.text('html')} AS body FROM pages")
def html_text(spark, sf_dir):
    """UD-03: titles and texts."""
    return views.table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.text(F.col("html")).alias("body"))


@register(f"WITH {sql.LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href, url FROM links")
def link_extract(spark, sf_dir):
    """UD-02, SC-U06: anchors and what they resolve to."""
    return views.links(spark, sf_dir).select("page_id", "pos", "href", "url")


STEPS = f"""WITH d AS (SELECT page_id, {sql.origin('url')} AS o, string_split({sql.path('url')}, '/') AS s FROM pages), f AS (SELECT page_id, o, s[2:len(s) - 1] AS folder FROM d)
SELECT page_id, o || '/' || array_to_string(list_concat(folder[1:len(folder) - 1], ['p' || page_id, '?x=../y']), '/') AS url FROM f"""


@register(STEPS)
def link_steps(spark, sf_dir):
    """SC-U06: relative links with steps up and in place, against every page."""
    href = F.concat(F.lit(".././p"), F.col("page_id").cast("string"), F.lit("/q/r/../../.?x=../y"))
    return views.table(spark, sf_dir, "pages").select("page_id", urls.resolve(href, F.col("url")).alias("url"))


@register(f"WITH {sql.LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, url, {sql.decision('url', 'page_url')} AS decision FROM links")
def link_ladder(spark, sf_dir):
    """PF-27: the decision for every link."""
    return crawl.ladder(views.links(spark, sf_dir)).select("page_id", "pos", "url", "decision")


@register(f"WITH {sql.LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM links QUALIFY row_number() OVER (PARTITION BY coalesce({sql.normalize('url')}, url) ORDER BY page_id, pos) = 1")
def link_once(spark, sf_dir):
    """WN-05, JN-13, PF-23: the first link per normalised URL."""
    return crawl.first_per_url(views.links(spark, sf_dir), ["page_id", "pos"]).select("page_id", "pos", "url")


@register(f"""WITH {sql.LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN {sql.is_http('url')} THEN {sql.origin('url')} || {sql.escaped(sql.path('url'))}
|| CASE WHEN contains(url, '?') THEN '?' || {sql.query('url')} ELSE '' END || CASE WHEN contains(url, '#') THEN '#' || string_split(url, '#')[2] ELSE '' END END AS url FROM links""")
def links_followed(spark, sf_dir):
    """SC-U01, SC-U06: where a browser goes by each anchor, by the URL standard."""
    return views.links(spark, sf_dir).select("page_id", "pos", urls.resolve_standard(F.col("href"), F.col("page_url")).alias("url"))


@register(f"WITH {sql.LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, url, CAST(row_number() OVER (PARTITION BY page_url ORDER BY page_id, pos) AS INTEGER) AS turn, min(page_id) OVER (PARTITION BY page_url) AS bucket_seq FROM links")
def frontier_order(spark, sf_dir):
    """WN-01: the fair order of the frontier."""
    return crawl.fair_order(views.links(spark, sf_dir), "page_url", ["page_id", "pos"]).select("page_id", "pos", "url", "turn", "bucket_seq")


@register(f"WITH k AS (SELECT page_id, {sql.thread_key('url')} AS thread FROM pages) SELECT page_id, thread, CAST(row_number() OVER (PARTITION BY thread ORDER BY page_id) AS INTEGER) AS page_index FROM k")
def page_index(spark, sf_dir):
    """WN-02/14, AG-17: running page index per thread."""
    rows = views.table(spark, sf_dir, "pages").select("page_id", urls.thread_key(F.col("url")).alias("thread"))
    return numbered(rows, ["thread"], ["page_id"], "page_index")


@register(f"""WITH RECURSIVE {sql.LINKS}, n AS (SELECT DISTINCT {sql.host('page_url')} AS src, href AS dst FROM links), edges AS (SELECT src, dst FROM n UNION SELECT dst, src FROM n),
r(url, depth) AS (SELECT url, 0 FROM (SELECT min({sql.host('url')}) AS url FROM pages) UNION SELECT dst, depth + 1 FROM r JOIN edges ON url = src WHERE depth < 6)
SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def crawl_reachability(spark, sf_dir):
    """ST-03: what a crawl reaches over hosts and the link targets that they share."""
    n = views.links(spark, sf_dir).select(urls.host(F.col("page_url")).alias("src"), F.col("href").alias("dst")).distinct()
    edges = settle(n.union(n.select("dst", "src")).distinct())
    seeds = views.table(spark, sf_dir, "pages").agg(F.min(urls.host(F.col("url"))).alias("url"))
    return crawl.reachable(edges, seeds, 6, settle)


@register(f"""WITH {sql.LINKS}, l AS (SELECT page_id, pos, url, {sql.normalize('url')} AS norm FROM links), r AS (SELECT norm, arg_max(page_id, page_id) AS target FROM (SELECT page_id, {sql.normalize('url')} AS norm FROM pages) GROUP BY norm)
SELECT l.page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN target IS NOT NULL THEN '/page/' || target ELSE '/__unavailable__?url=' || url_encode(url) END AS local FROM l LEFT JOIN r ON l.norm = r.norm""")
def link_rewrite_route(spark, sf_dir):
    """JN-04/15, WN-09, UD-07, SC-U13: links rewritten to archive paths."""
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), urls.normalize(F.col("url")).alias("norm"), F.col("page_id").alias("target"))
    return container.rewritten(views.links(spark, sf_dir).withColumn("norm", urls.normalize(F.col("url"))), container.last_routes(pages)).select("page_id", "pos", "local")


# Container

@register("SELECT sha256(text) AS sha256, min(doc_id) AS first_seq, any_value(strlen(text)) AS byte_size, count(*) AS n_writes, count(DISTINCT source || '/' || lang) AS n_urls FROM documents GROUP BY 1")
def asset_dedup(spark, sf_dir):
    """AG-08, SC-H01: content-addressed dedup."""
    docs = views.table(spark, sf_dir, "documents")
    return container.dedup_assets(docs.select(F.col("doc_id").alias("seq"), F.concat_ws("/", "source", "lang").alias("url"), F.col("text").alias("content")))


@register("SELECT doc_id, CASE WHEN n_chars > 2000 THEN true WHEN n_chars > 1000 THEN false ELSE true END AS ok FROM documents")
def integrity_check(spark, sf_dir):
    """SRC-08, CP-13: contents against their recorded hashes; no hash, nothing to verify."""
    expected = F.when(F.col("n_chars") > 2000, F.sha2("text", 256)).when(F.col("n_chars") > 1000, F.sha2("source", 256))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), expected.alias("expected"))
    return container.verified(docs).select("doc_id", "ok")


CONTENT_TYPES = {"src0": "text/HTML; charset=utf-8", "src1": "image/svg+xml", "src2": "font/woff2", "src3": "Video/mp4", "src4": "text/css", "src5": "application/pdf", "src6": "text/javascript", "src7": "application/x-font-ttf"}
_CT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTENT_TYPES.items())


@register(f"""WITH c AS (SELECT doc_id, lower(trim(string_split(CASE source {_CT} ELSE source END, ';')[1])) AS b FROM documents)
SELECT doc_id, CASE WHEN b LIKE 'image/%' THEN 'image' WHEN b LIKE '%font%' THEN 'font' WHEN b LIKE 'video/%' OR b LIKE 'audio/%' THEN 'media' WHEN b = 'text/css' THEN 'stylesheet'
WHEN b IN ('application/javascript', 'text/javascript') THEN 'script' WHEN b = 'application/pdf' OR b LIKE 'application/vnd.%' THEN 'document' ELSE 'other' END AS kind,
CASE b {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in container.EXTENSIONS.items())} ELSE 'bin' END AS ext FROM c""")
def asset_kind(spark, sf_dir):
    """SC-S06/07, SRC-31: kinds and extensions of content types."""
    ct = F.coalesce(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])[F.col("source")], F.col("source"))
    return views.table(spark, sf_dir, "documents").select("doc_id", container.asset_kind(ct).alias("kind"), container.file_extension(ct).alias("ext"))


# Journal, failures and navigation

@register(f"WITH {sql.JOURNAL} SELECT archive_id, norm, min(seq) AS seq FROM journal e WHERE t = 'enq' AND NOT EXISTS (SELECT 1 FROM journal d WHERE d.t = 'deq' AND d.archive_id = e.archive_id AND d.norm = e.norm) GROUP BY ALL")
def journal_pending(spark, sf_dir):
    """JN-06, ST-06: the queue that a crash left."""
    return journal.pending(views.journal(spark, sf_dir)).select("archive_id", "norm", "seq")


@register(f"""WITH {sql.JOURNAL} SELECT DISTINCT archive_id, norm FROM journal e WHERE t = 'enq' AND EXISTS (SELECT 1 FROM journal d WHERE d.t = 'deq' AND d.archive_id = e.archive_id AND d.norm = e.norm)
AND NOT EXISTS (SELECT 1 FROM journal d WHERE d.t IN ('page', 'failure') AND d.archive_id = e.archive_id AND d.norm = e.norm)""")
def journal_interrupted(spark, sf_dir):
    """JN-06: taken but never resolved."""
    return journal.interrupted(views.journal(spark, sf_dir))


@register(f"""WITH {sql.JOURNAL} SELECT archive_id, count(*) FILTER (t = 'page') AS n_pages, count(*) FILTER (t = 'failure') AS n_failures, count(*) FILTER (t = 'enq') AS n_discovered,
arg_max(value, seq) FILTER (t = 'stat') AS last_value, count(*) FILTER (t = 'page') > 0 AS can_finish FROM journal GROUP BY archive_id""")
def journal_state(spark, sf_dir):
    """ST-06, AG-12/20/21: the folded state."""
    return journal.state(views.journal(spark, sf_dir))


@register(f"""WITH {sql.JOURNAL}, i AS (SELECT *, sum(CASE WHEN t = 'failure' THEN 0 ELSE 1 END) OVER (PARTITION BY archive_id ORDER BY seq) AS island FROM journal),
s AS (SELECT archive_id, seq, CAST(row_number() OVER (PARTITION BY archive_id, island ORDER BY seq) AS INTEGER) AS streak FROM i WHERE t = 'failure') SELECT *, streak % 3 = 0 AS triggers FROM s""")
def degraded_streak(spark, sf_dir):
    """WN-11: runs of failures per worker."""
    return journal.streaks(views.journal(spark, sf_dir))


@register(f"WITH {sql.JOURNAL} SELECT archive_id, seq, lag(norm) OVER (PARTITION BY archive_id ORDER BY seq) AS referrer FROM journal")
def referrer_lag(spark, sf_dir):
    """WN-12: the page before."""
    return journal.referrers(views.journal(spark, sf_dir)).select("archive_id", "seq", "referrer")


@register(f"WITH {sql.JOURNAL}, n AS (SELECT *, lead(ts) OVER (PARTITION BY archive_id ORDER BY ts, seq) AS nxt FROM journal) SELECT archive_id, seq, norm FROM n WHERE nxt IS NULL OR nxt - ts > INTERVAL 3 HOURS")
def debounce_last(spark, sf_dir):
    """ST-01: the last visit of each burst."""
    return journal.debounced(views.journal(spark, sf_dir), 3 * 3600).select("archive_id", "seq", "norm")


KINDS = "CASE event_type WHEN 'view' THEN 'skipped-trap' WHEN 'click' THEN 'skipped-duplicate' WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'cancelled' ELSE 'fetch-failed' END"


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://a.example/"), F.get_json_object("props", "$.k"), F.lit("/?utm_source=x"))
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), url.alias("url"), F.expr(KINDS).alias("kind"))


FAILURES = f"failures AS (SELECT event_id AS seq, 'https://a.example/' || json_extract_string(props, '$.k') || '/?utm_source=x' AS url, {KINDS} AS kind FROM events)"


@register(f"WITH {FAILURES}, k AS (SELECT * FROM failures QUALIFY kind NOT LIKE 'skipped-%' OR row_number() OVER (PARTITION BY kind ORDER BY seq) <= 500) SELECT seq, url, kind FROM k ORDER BY seq LIMIT 5000")
def failure_caps(spark, sf_dir):
    """WN-06: the bounded failure list."""
    return crawl.capped_failures(failures(spark, sf_dir), "seq")


@register(f"WITH {FAILURES} SELECT kind, count(*) AS n FROM failures GROUP BY kind")
def failures_by_kind(spark, sf_dir):
    """AG-07: counts beyond the caps too."""
    return failures(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@register(f"WITH {FAILURES} SELECT seq, url, kind FROM failures WHERE kind IN ({sql.quoted(crawl.RETRYABLE)}) QUALIFY row_number() OVER (PARTITION BY {sql.normalize('url')} ORDER BY seq) = 1")
def retryable_once(spark, sf_dir):
    """WN-07, PF-24: the first retryable failure per URL."""
    return crawl.first_per_url(failures(spark, sf_dir).where(F.col("kind").isin(*crawl.RETRYABLE)), ["seq"])


@register("""SELECT count(DISTINCT conv_id) AS n_threads, count(DISTINCT role) AS n_sections, count(*) AS n_posts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations""")
def forum_summary(spark, sf_dir):
    """AG-06: threads, sections and posts."""
    posts = views.posts(spark, sf_dir)
    return posts.agg(F.count_distinct("thread_key").alias("n_threads"), F.count_distinct("author").alias("n_sections"), F.count("*").alias("n_posts"), F.sum(F.char_length("body")).alias("n_chars"))


@register("SELECT conv_id || '#' || turn % 3 AS post_id, arg_min(length(text), turn) AS n_chars, min(turn) AS post_number FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def posts_once(spark, sf_dir):
    """WN-08, CP-07: the first post of each id."""
    rows = views.posts(spark, sf_dir).where("body is not null").select(F.concat_ws("#", "thread_key", F.col("post_number") % 3).alias("post_id"), "post_number", F.char_length("body").cast("long").alias("n_chars"))
    return catalog.first_of(rows, "post_id", "post_number")


# Links with attributes, resources and forms


@register(f"WITH {sql.ANCHORS} SELECT page_id, CAST(pos AS INTEGER) AS pos, url, text, rel, download, in_form FROM anchors")
def link_details(spark, sf_dir):
    """UD-02: anchors with their texts and attributes."""
    return views.anchors(spark, sf_dir).select("page_id", "pos", "url", "text", "rel", "download", "in_form")


@register(rf"""WITH {sql.DECORATED}, lists AS (SELECT page_id, unnest(regexp_extract_all(html, '<img [^>]*srcset="([^"]*)"', 1)) AS list FROM decorated), sets AS (SELECT page_id, unnest(string_split(list, ',')) AS part FROM lists)
SELECT page_id, unnest(regexp_extract_all(html, '<link rel="stylesheet" href="([^"]*)"', 1)) AS href, 'stylesheet' AS kind FROM decorated
UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<img src="([^"]*)"', 1)), 'image' FROM decorated UNION ALL SELECT page_id, string_split(trim(part), ' ')[1], 'image' FROM sets""")
def resource_extract(spark, sf_dir):
    """UD-01: what pages load."""
    return views.decorated_pages(spark, sf_dir).select("page_id", F.explode(forms.resources(F.col("html"))).alias("r")).select("page_id", "r.*")


@register(rf"""WITH {sql.DECORATED}, c AS (SELECT page_id, regexp_replace(html, '(<input type="hidden"[^>]*?) value="[^"]*"', '\1 value=""', 'g') AS cleared FROM decorated)
SELECT page_id, sha256(cleared) AS sha256, length(cleared) AS n_chars FROM c""")
def html_without_credentials(spark, sf_dir):
    """UD-04/05: pages whose credential fields have no values."""
    cleared = views.decorated_pages(spark, sf_dir).select("page_id", forms.without_credentials(F.col("html")).alias("cleared"))
    return cleared.select("page_id", F.sha2("cleared", 256).alias("sha256"), F.char_length("cleared").cast("long").alias("n_chars"))


FORUM = forum.ForumScope("https://m.ththth.example.net/", domains=("example.net", "example.com"), max_depth=2)
_U, _P = "url", "page_url"
_SCOPE = f"({sql.origin(_U)} = 'https://m.ththth.example.net' OR {' OR '.join(f'{sql.host(_U)} = {chr(39)}{d}{chr(39)} OR {sql.host(_U)} LIKE {chr(39)}%.{d}{chr(39)}' for d in FORUM.domains)})"


@register(rf"""WITH {sql.ANCHORS}, l AS (SELECT *, page_id % 3 AS depth, NOT starts_with({sql.path(_U)}, '/a') AS robots_allowed,
  {sql.shape(_U, urls.PAGINATION_PATH, urls.PAGINATION_PARAM, urls.PAGINATION_OFFSET)} OR ({sql.is_http(_U)} AND regexp_matches(trim(text), '{urls.PAGINATION_TEXT}')) AS pagination FROM anchors),
e AS (SELECT *, CASE WHEN NOT {sql.is_http(_U)} THEN 'drop' WHEN {sql.shape(_U, urls.DESTRUCTIVE_PATH, urls.DESTRUCTIVE_PARAM)} THEN 'skipped-sensitive' WHEN in_form OR rel = 'nofollow' THEN 'drop'
  WHEN NOT {_SCOPE} THEN 'drop' WHEN NOT robots_allowed THEN 'skipped-non-content' WHEN {sql.shape(_U, urls.PRINT_PATH, urls.PRINT_PARAM)} THEN 'skipped-duplicate'
  WHEN download OR {sql.attachment(_U)} THEN 'attachment' WHEN NOT pagination AND {sql.trap(_U)} THEN 'skipped-trap' END AS early FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY {sql.thread_key(_P)}, pagination AND early IS NULL ORDER BY page_id, pos) AS hop, depth + CASE WHEN pagination THEN 0 ELSE 1 END AS next_depth FROM e)
SELECT page_id, CAST(pos AS INTEGER) AS pos, url, next_depth, CASE WHEN early IS NOT NULL THEN early WHEN pagination AND hop > {crawl.MAX_PAGINATION_HOPS} THEN 'skipped-trap'
  WHEN {sql.shape(_U, urls.NON_CONTENT_PATH, urls.NON_CONTENT_PARAM)} THEN 'skipped-non-content' WHEN NOT pagination AND next_depth > 2 THEN 'drop' ELSE 'enqueue' END AS decision FROM h""")
def forum_ladder(spark, sf_dir):
    """PF-27, WN-14: every rule of a forum crawl's ladder."""
    links = views.anchors(spark, sf_dir).withColumn("depth", F.col("page_id") % 3).withColumn("robots_allowed", ~urls.path(F.col("url")).startswith("/a"))
    return forum.ladder(links, FORUM, ["page_id", "pos"]).select("page_id", "pos", "url", "next_depth", "decision")


# Zips, journal lines and streams


@register("SELECT 'documents/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS n_bytes FROM documents")
def zip_roundtrip(spark, sf_dir):
    """SRC-04/05/06/18: documents written to zips and read back."""
    docs = views.table(spark, sf_dir, "documents")
    files = docs.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    packed = settle(zips.zipped(files)).withColumn("zip", F.sha2("content", 256))
    return zips.entries(packed).select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


@register(f"WITH {sql.JOURNAL} SELECT t, count(*) AS n FROM journal GROUP BY t UNION ALL SELECT 'malformed', count(*) FROM journal WHERE seq % 97 = 0")
def journal_lines(spark, sf_dir):
    """SRC-10/12: a journal of JSON lines with torn ones, read back."""
    records, path = views.journal(spark, sf_dir).select("archive_id", "seq", "t", "norm", "value"), new_path(spark)
    journal_log.append(records, path)
    torn = records.where("seq % 97 = 0").select(F.substring(F.to_json(F.struct("*")), 1, 20).alias("value"))
    torn.write.mode("append").text(path)
    return journal_log.read(spark, path).groupBy(F.when(F.col("malformed"), "malformed").otherwise(F.col("t")).alias("t")).agg(F.count("*").alias("n"))


@register(f"""WITH {sql.JOURNAL}, n AS (SELECT *, lead(ts) OVER (PARTITION BY archive_id ORDER BY ts, seq) AS nxt FROM journal), m AS (SELECT date_trunc('millisecond', max(ts)) AS mark FROM journal)
SELECT archive_id, seq, norm FROM n, m WHERE (nxt IS NULL OR nxt - ts > INTERVAL 3 HOURS) AND ts + INTERVAL 3 HOURS <= mark""")
def stream_debounced(spark, sf_dir):
    """ST-01: a stream's last visits of bursts that the watermark has closed."""
    records = views.as_journal(visits.arriving(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return visits.appended(visits.debounced(records, "3 hours", "0 seconds"))


@register(ORACLE_SQL["journal_state"])
def stream_state(spark, sf_dir):
    """ST-06: the folded state of a stream of records."""
    return visits.completed(visits.state(views.as_journal(visits.arriving(spark, sf_dir, "events"))))


# Budgets, retries and navigation

TAKEN = f"{sql.JOURNAL}, taken AS (SELECT archive_id, seq, CAST(round(value * 100) AS BIGINT) AS size FROM journal WHERE t = 'page')"


@register(f"""WITH {TAKEN}, b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY archive_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (PARTITION BY archive_id ORDER BY seq) - 1 AS done FROM taken), w AS (SELECT *, CASE WHEN before >= 10000 THEN 'bytes' WHEN done >= 3 THEN 'pages' END AS why FROM b)
SELECT archive_id, count(*) FILTER (why IS NULL) AS n_pages, CAST(coalesce(sum(size) FILTER (why IS NULL), 0) AS BIGINT) AS n_bytes, arg_min(why, seq) FILTER (why IS NOT NULL) AS stopped_by, count(*) FILTER (why IS NOT NULL) AS n_left FROM w GROUP BY archive_id""")
def page_budget(spark, sf_dir):
    """WN-13, ST-10: what a capture takes before its budget is used up."""
    pages = views.journal(spark, sf_dir).where("t = 'page'").select("archive_id", "seq", F.round(F.col("value") * 100).cast("long").alias("size"))
    return budget.within_budget(pages, 3, 10_000)


@register(f"WITH {sql.JOURNAL}, n AS (SELECT *, lag(norm) OVER (PARTITION BY archive_id ORDER BY seq) AS prev FROM journal) SELECT archive_id, seq, norm FROM n WHERE prev IS NULL OR norm IS DISTINCT FROM prev")
def navigation_once(spark, sf_dir):
    """ST-02: visits that leave the page captured last."""
    return budget.without_repeats(views.journal(spark, sf_dir)).select("archive_id", "seq", "norm")


@register(f"""WITH {sql.JOURNAL}, k AS (SELECT *, lag(norm) OVER (PARTITION BY archive_id ORDER BY seq) AS discovered_on FROM journal), p AS (SELECT norm, min(archive_id % 4) AS depth FROM journal WHERE t = 'page' GROUP BY norm)
SELECT k.archive_id, k.seq, coalesce(p.depth + 1, 0) AS depth FROM k LEFT JOIN p ON k.discovered_on = p.norm WHERE t = 'failure'""")
def retry_depths(spark, sf_dir):
    """JN-09: the depth at which failures are attempted again."""
    records = views.journal(spark, sf_dir)
    failed = journal.referrers(records).where("t = 'failure'").withColumnRenamed("referrer", "discovered_on")
    pages = records.where("t = 'page'").select("norm", (F.col("archive_id") % 4).alias("depth"))
    return budget.retry_depth(failed, pages).select("archive_id", "seq", "depth")


@register("""WITH j AS (SELECT event_id AS seq, user_id || '/' || json_extract_string(props, '$.k') AS norm, event_type AS t FROM events)
SELECT seq, norm FROM j WHERE t = 'purchase' AND norm NOT IN (SELECT norm FROM j WHERE t = 'error')""")
def retry_keeps(spark, sf_dir):
    """JN-08, CP-09: pages that a retry carries over."""
    rows = views.journal(spark, sf_dir).select("seq", "t", F.concat_ws("/", "archive_id", "norm").alias("norm"))
    return budget.carried_over(rows.where("t = 'page'"), rows.where("t = 'failure'")).select("seq", "norm")


# Strings


@register(r"""SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: '"' || replace(w, '"', '""') || '"*'), ' '), '') AS query,
replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM conversations""")
def text_escapes(spark, sf_dir):
    """SC-S01/03: match queries and HTML escapes."""
    rows = views.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.coalesce(text.match_query(F.col("text")), F.lit("")).alias("query"), text.escaped(F.col("text")).alias("escaped"))


NAMED = "CASE WHEN page_id % 9 = 4 THEN '' ELSE {t} END"


@register(rf"""WITH p AS (SELECT page_id, url, {NAMED.format(t=sql.title('html'))} AS t, {sql.host('url')} AS h, length(html) * CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS n FROM pages)
SELECT page_id, left(trim(regexp_replace(CASE WHEN t = '' THEN h ELSE t END, '[/\\?%*:|"<>]', '-', 'g')), 80) || '.archive.zip' AS filename,
CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024.0, 1)) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', round(n / 1048576.0, 1)) || ' MB' ELSE printf('%.1f', round(n / 1073741824.0, 1)) || ' GB' END AS size,
regexp_matches(url, '{text.SENSITIVE_URL}') AS sensitive FROM p""")
def page_labels(spark, sf_dir):
    """SC-U11, SC-S05, PF-25: file names, sizes in every unit and sensitive URLs; a page without a title takes its host's name."""
    i = F.col("page_id")
    title = F.when(i % 9 == 4, "").otherwise(html.title(F.col("html")))
    n = F.char_length("html").cast("long") * F.when(i % 3 == 0, 1).when(i % 3 == 1, 1024).otherwise(1048576)
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), n.alias("n"))
    return pages.select("page_id", text.archive_filename(F.col("title"), urls.host(F.col("url"))).alias("filename"), text.file_size(F.col("n")).alias("size"), text.is_sensitive_url(F.col("url")).alias("sensitive"))


@register(rf"""WITH typed AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN {sql.host('url')} ELSE 'find ' || {sql.host('url')} END AS t FROM pages)
SELECT page_id, CASE WHEN starts_with(t, 'http') THEN t WHEN starts_with(t, 'find') THEN 'https://s.example/?q=' || url_encode(t) ELSE 'https://' || t END AS target FROM typed""")
def address_bar(spark, sf_dir):
    """SC-U10: what typed input opens."""
    host = urls.host(F.col("url"))
    typed = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, host).otherwise(F.concat(F.lit("find "), host))
    return views.table(spark, sf_dir, "pages").select("page_id", text.address(typed, "https://s.example/?q=%s").alias("target"))


from pagestrata.plans import archive_queries, folder_queries, index_queries, markup_queries, replay_queries, request_queries, selection_queries, snippet_queries, stored_queries  # noqa: E402, F401
