"""More registered queries: what a capture fetches, library searches, phrases and snippets, limits of changes, resumed threads and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import urls
from pagestrata.operators import budget, catalog, crawl, library, search
from pagestrata.plans import indexes, sql
from pagestrata.plans.registry import ACTIVE, BOTH_WORDS, PAGE_WEIGHTS, active, register
from pagestrata.sources import journal_log, views
from pagestrata.sources.tables import new_path, settle

START = "https://m.ththth.example.net/"
SCOPES = {
    "all": crawl.ResourceScope(START),
    "no documents": crawl.ResourceScope(START, documents=False),
    "no attachments": crawl.ResourceScope(START, attachments=False, media=False),
    "own images": crawl.ResourceScope(START, external_images=False, forum=True),
}
LOADED = rf"""{sql.ANCHORS}, hrefs AS (SELECT page_id, url AS page_url, '/s/' || page_id || '.css' AS href, 'stylesheet' AS kind, 0 AS pos FROM decorated
  UNION ALL SELECT page_id, url, unnest(['/i/' || page_id || '.png', '/i/a.png', '/i/b.png']), 'image', 1 FROM decorated),
resources AS (SELECT page_id, {sql.resolve('href', 'page_url')} AS url, kind, pos FROM hrefs UNION ALL SELECT page_id, url, 'attachment', 2 FROM anchors WHERE download OR {sql.attachment('url')}),
firsts AS (SELECT page_id, url, arg_min(kind, pos) AS kind FROM resources GROUP BY page_id, url)"""


@register(f"""WITH {LOADED} SELECT 'all' AS scope, page_id, url, kind FROM firsts
UNION ALL SELECT 'no documents', page_id, url, kind FROM firsts WHERE {sql.extension('url')} NOT IN ({sql.quoted(urls.DOCUMENT_EXTENSIONS)})
UNION ALL SELECT 'no attachments', page_id, url, kind FROM firsts WHERE kind <> 'attachment' AND {sql.extension('url')} NOT IN ({sql.quoted(urls.MEDIA_EXTENSIONS)})
UNION ALL SELECT 'own images', page_id, url, kind FROM firsts WHERE kind <> 'image' OR {sql.origin('url')} = 'https://m.ththth.example.net'""")
def resource_selection(spark, sf_dir):
    """PF-23, UD-01: what captures of four scopes fetch beside pages."""
    found = views.resources(spark, sf_dir)
    out = None
    for name, scope in SCOPES.items():
        one = crawl.selected_resources(found, scope).select(F.lit(name).alias("scope"), "page_id", "url", "kind")
        out = one if out is None else out.unionByName(one)
    return out


PLACES = 200


@register(f"""WITH {sql.LINKS}, d AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, url, {sql.decision('url', 'page_url')} AS decision, {sql.normalize('url')} AS norm FROM links),
starts AS (SELECT min(url) AS url FROM pages GROUP BY coalesce(list_filter(string_split({sql.path('url')}, '/'), lambda s: s <> '')[1], '')), known AS (SELECT DISTINCT {sql.normalize('url')} AS norm FROM starts),
fresh AS (SELECT norm, min((page_id, pos)) AS spot FROM d WHERE decision = 'enqueue' AND norm NOT IN (SELECT norm FROM known) GROUP BY norm),
ranked AS (SELECT spot, row_number() OVER (ORDER BY spot) AS place FROM fresh), final AS (SELECT max(spot) AS spot FROM ranked WHERE place = {PLACES} - (SELECT count(*) FROM known))
SELECT page_id, pos, url, decision FROM d, final WHERE {PLACES} > (SELECT count(*) FROM known) AND (final.spot IS NULL OR (page_id, pos) <= final.spot)""")
def ladder_until_full(spark, sf_dir):
    """PF-27, JN-13, ST-10: decisions up to the link that fills the last place of a crawl, which starts from a page of each section."""
    starts = views.table(spark, sf_dir, "pages").groupBy(urls.leading_segment(F.col("url"))).agg(F.min("url").alias("url"))
    known = starts.select(urls.normalize(F.col("url")).alias("norm")).distinct()
    decided = settle(crawl.ladder(views.links(spark, sf_dir)).select("page_id", "pos", "url", "decision"))
    return crawl.until_full(decided, known, ["page_id", "pos"], PLACES)


# Search

FOUND = catalog.LibraryQuery(search=" ".join(BOTH_WORDS), status="success", sort="size", limit=500)


def _snippet_sql(columns: list[str], words: list[str], width: int = 10) -> str:
    """SELECT of id and snippet over a relation found, by joins of window starts and hits."""
    tok = r"regexp_split_to_array(lower(strip_accents(w)), '[^\p{L}\p{N}]+')"
    hit = " + ".join(f"CASE WHEN len(list_filter({tok}, lambda t: starts_with(t, '{w}'))) > 0 THEN {1 << i} ELSE 0 END" for i, w in enumerate(words))
    each = " UNION ALL ".join(f"SELECT id, {i} AS col, list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '') AS ws FROM found" for i, c in enumerate(columns))
    return f"""split_words AS ({each}), numbered AS (SELECT id, col, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS total FROM split_words),
hits AS (SELECT *, {hit} AS hit FROM numbered), starts AS (SELECT a.id, a.col, a.i, bit_count(bit_or(b.hit)) AS n FROM hits a JOIN hits b ON a.id = b.id AND a.col = b.col AND b.i BETWEEN a.i AND a.i + {width - 1} WHERE a.hit > 0 GROUP BY a.id, a.col, a.i),
top AS (SELECT id, col, i FROM starts QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, col, i) = 1),
snippets AS (SELECT h.id, CASE WHEN any_value(t.i) > 1 THEN '…' ELSE '' END || string_agg(CASE WHEN hit > 0 THEN chr(1) || w || chr(2) ELSE w END, ' ' ORDER BY h.i) || CASE WHEN any_value(total) > any_value(t.i) - 1 + {width} THEN '…' ELSE '' END AS snippet
  FROM top t JOIN hits h ON h.id = t.id AND h.col = t.col AND h.i BETWEEN t.i AND t.i + {width - 1} GROUP BY h.id)"""


@register(f"""WITH {sql.ARCHIVES}, {ACTIVE}, {sql.search('active', BOTH_WORDS, PAGE_WEIGHTS)}, {_snippet_sql(list(search.LIBRARY_WEIGHTS), BOTH_WORDS)}
SELECT f.id, round(score, 6) AS score, snippet FROM found f JOIN snippets s ON s.id = f.id WHERE status = 'success' ORDER BY round(score, 9), f.id LIMIT 500""")
def library_search_page(spark, sf_dir):
    """PF-08, SL-02, FT-06, UD-11: a page of a library search with filters: best first whatever the sort, each with its best window over all columns."""
    rows = views.archives(spark, sf_dir)
    return FOUND.page(rows, indexes.library(rows.where("not deleted"))).select("id", F.round("score", 6).alias("score"), "snippet")


@register(f"WITH {sql.ARCHIVES} SELECT id, CAST(NULL AS VARCHAR) AS snippet FROM archives WHERE NOT deleted ORDER BY size_bytes DESC, id LIMIT 50")
def library_blank_search(spark, sf_dir):
    """FT-08, SL-01: a blank search is none: the library in its sort, without snippets."""
    return catalog.LibraryQuery(search=" \t", sort="size").page(views.archives(spark, sf_dir)).select("id", "snippet")


PHRASE_TF = r"len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'thin' AND starts_with(ts[i + 1], 're')))"


@register(rf"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS ts FROM documents),
c AS (SELECT id, len(ts) AS dl, CAST({PHRASE_TF} AS DOUBLE) AS tf FROM t), s AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (tf > 0) AS df FROM c)
SELECT id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score FROM c, s WHERE tf > 0""")
def fts_phrase(spark, sf_dir):
    """FT-03: documents with a phrase inside one column, its last token as a prefix, and their rank."""
    return indexes.documents(views.table(spark, sf_dir, "documents")).search("thin-re").select("id", F.round("score", 6).alias("score"))


@register(rf"""WITH d AS (SELECT doc_id, text, list_filter(string_split(text, ' '), lambda w: w <> '') AS tags FROM documents),
u AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]')) AS n FROM d)
SELECT doc_id, CASE WHEN n > 500 THEN 'title-too-long' WHEN len(tags) > 32 THEN 'too-many-tags' WHEN len(list_filter(tags, lambda t: length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')) > 64)) > 0 THEN 'tag-too-long' END AS fault FROM u""")
def change_limits(spark, sf_dir):
    """PF-35: which documents' texts as titles, and words as tags, a change of an archive may set."""
    tags = F.filter(F.split("text", " "), lambda w: w != "")
    return views.table(spark, sf_dir, "documents").select("doc_id", library.change_fault(F.col("text"), tags).alias("fault"))


# Resumed captures and logs


@register(f"""WITH p AS (SELECT page_id, {sql.thread_key('url')} AS thread_key, CASE WHEN page_id % 5 > 0 THEN CAST(page_id % 7 AS INTEGER) END AS page_index FROM pages),
k AS (SELECT thread_key, max(page_index) AS highest FROM p WHERE page_id % 2 = 0 AND page_index > 0 GROUP BY thread_key)
SELECT page_id, CAST(coalesce(highest, 0) + row_number() OVER (PARTITION BY p.thread_key ORDER BY page_id) AS INTEGER) AS page_index FROM p LEFT JOIN k ON p.thread_key = k.thread_key WHERE page_id % 2 = 1""")
def resume_page_index(spark, sf_dir):
    """AG-17, WN-02: pages captured after a resume, numbered on from the highest index of their thread."""
    index = F.when(F.col("page_id") % 5 > 0, (F.col("page_id") % 7).cast("int"))
    pages = views.table(spark, sf_dir, "pages").select("page_id", urls.thread_key(F.col("url")).alias("thread_key"), index.alias("page_index"))
    odd = F.col("page_id") % 2 == 1
    return budget.numbered_on(pages.where(odd).drop("page_index"), pages.where(~odd), ["page_id"]).select("page_id", "page_index")


@register(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'warn' ELSE 'info' END AS level, 'capture.page' AS message, CASE WHEN page_id % 11 = 0 THEN '[unparsable-url]' ELSE {sql.origin('url')} END AS url FROM pages")
def log_redacted(spark, sf_dir):
    """SRC-25, SC-U12, SC-D01: log entries written as JSON lines and read back, with URLs cut to scheme and host."""
    level = F.when(F.col("page_id") % 3 == 0, "warn").otherwise("info")
    url = F.when(F.col("page_id") % 11 == 0, "no url").otherwise(F.col("url"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), views.STAMP)
    path = new_path(spark)
    journal_log.log(views.table(spark, sf_dir, "pages").select("page_id", stamp.alias("ts"), level.alias("level"), F.lit("capture.page").alias("message"), url.alias("url")), path)
    return journal_log.read_log(spark, path, "page_id long, ts string, level string, message string, url string").drop("ts")
