"""More registered queries: journal replay, library changes and transfer, container lookups, in-archive search and forum posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import posts, urls
from pagestrata.operators import archive, catalog, library, replay, results
from pagestrata.plans import indexes, sql
from pagestrata.plans.registry import active, register
from pagestrata.sources import views

K = "CAST(k AS BIGINT)"
#: Columns of journal records over events with k, in words that both engines read.
RECORD = f"""CASE event_type WHEN 'view' THEN 'enq' WHEN 'click' THEN 'deq' WHEN 'purchase' THEN 'page' WHEN 'error' THEN (CASE WHEN {K} % 2 = 0 THEN 'failure' ELSE 'route' END)
  ELSE (CASE {K} % 4 WHEN 0 THEN 'asset' WHEN 1 THEN 'assetUrl' WHEN 2 THEN 'forumPost' ELSE 'stat' END) END"""
FIELDS = f"""user_id AS archive_id, event_id AS seq, ts, k AS norm, {RECORD} AS t, concat('s', CAST({K} % 3 AS STRING)) AS sha, concat('http://x.example/', CAST(event_id % 50 AS STRING)) AS url,
  CASE WHEN {K} % 8 = 3 THEN '' ELSE concat('title ', CAST(event_id AS STRING)) END AS title, concat('p', CAST(event_id AS STRING)) AS target, concat(CAST({K} % 7 AS STRING), '#post-', CAST({K} % 5 AS STRING)) AS post_id,
  CASE WHEN {K} % 10 = 0 THEN 'stopped-at-limit' WHEN {K} % 10 = 2 THEN 'timeout' ELSE 'fetch-failed' END AS kind, concat('limit ', k) AS message"""
RECORDS = f"records AS (SELECT {FIELDS.replace('STRING', 'VARCHAR')} FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))"
INTERRUPTED = """interrupted AS (SELECT DISTINCT archive_id, norm FROM records e WHERE t = 'enq' AND EXISTS (SELECT 1 FROM records d WHERE d.t = 'deq' AND d.archive_id = e.archive_id AND d.norm = e.norm)
  AND NOT EXISTS (SELECT 1 FROM records d WHERE d.t IN ('page', 'failure') AND d.archive_id = e.archive_id AND d.norm = e.norm))"""
FAILED = f"{INTERRUPTED}, failed AS (SELECT archive_id, norm, kind, seq FROM records WHERE t = 'failure' UNION ALL SELECT archive_id, norm, 'interrupted', NULL FROM interrupted)"
PENDING = "pending AS (SELECT archive_id, norm, min(seq) AS seq FROM records e WHERE t = 'enq' AND NOT EXISTS (SELECT 1 FROM records d WHERE d.t = 'deq' AND d.archive_id = e.archive_id AND d.norm = e.norm) GROUP BY ALL)"
ASSETS = """last_asset AS (SELECT archive_id, sha, max(seq) AS seq, arg_max(url, seq) AS url, arg_max(kind, seq) AS kind FROM records WHERE t = 'asset' GROUP BY ALL),
  added AS (SELECT a.archive_id, a.sha, r.url AS more, min(r.seq) AS pos_at FROM last_asset a JOIN records r ON r.t = 'assetUrl' AND r.archive_id = a.archive_id AND r.sha = a.sha AND r.seq > a.seq AND r.url <> a.url GROUP BY ALL),
  assets AS (SELECT a.archive_id, a.sha, a.seq, a.kind, a.url || coalesce((SELECT string_agg('|' || more, '' ORDER BY pos_at) FROM added d WHERE d.archive_id = a.archive_id AND d.sha = a.sha), '') AS sources FROM last_asset a)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal records of every type, one capture per user."""
    with_k = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return with_k.selectExpr(*[c.strip() for c in _split(FIELDS)])


def _split(columns: str) -> list[str]:
    """The expressions of a SELECT list, split at its outer commas."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


# Journal replay


@register(f"WITH {RECORDS}, {ASSETS} SELECT * FROM assets")
def replay_assets(spark, sf_dir):
    """ST-06, CP-08, SC-A02: assets, the last record first, with the URLs added after it."""
    return replay.assets(records(spark, sf_dir)).withColumn("sources", F.array_join("sources", "|"))


@register(f"WITH {RECORDS} SELECT archive_id, norm, arg_max(target, seq) AS target FROM records WHERE t = 'route' GROUP BY ALL")
def replay_routes(spark, sf_dir):
    """ST-06, DM-07: the last route of each URL."""
    return replay.routes(records(spark, sf_dir))


@register(f"WITH {RECORDS} SELECT archive_id, post_id, min(seq) AS seq FROM records WHERE t = 'forumPost' GROUP BY ALL")
def replay_posts(spark, sf_dir):
    """ST-06, WN-08: the first record of each post."""
    return replay.posts(records(spark, sf_dir))


@register(f"WITH {RECORDS}, {FAILED} SELECT * FROM failed")
def replay_failures(spark, sf_dir):
    """ST-06, JN-06: failures with those that the crash made."""
    return replay.failures(records(spark, sf_dir))


@register(f"WITH {RECORDS}, {PENDING} SELECT archive_id, norm, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY seq) AS INTEGER) AS place FROM pending")
def replay_queue(spark, sf_dir):
    """ST-06, ST-07: the queue in order."""
    return replay.queue(records(spark, sf_dir))


COUNTS = f"""{RECORDS}, {FAILED}, {PENDING}, {ASSETS}, base AS (SELECT archive_id, count(*) FILTER (t = 'page') AS n_pages, count(*) FILTER (t = 'enq') AS n_discovered,
  count(DISTINCT norm) FILTER (t = 'route') AS n_routes, count(DISTINCT post_id) FILTER (t = 'forumPost') AS n_posts, arg_max(title, seq) FILTER (t = 'stat' AND title <> '') AS title, max(ts) AS last_write FROM records GROUP BY ALL),
summary AS (SELECT b.archive_id, n_pages, n_discovered, (SELECT count(*) FROM assets a WHERE a.archive_id = b.archive_id) AS n_assets, n_routes, n_posts, (SELECT count(*) FROM failed f WHERE f.archive_id = b.archive_id) AS n_failures,
  (SELECT count(*) FROM pending p WHERE p.archive_id = b.archive_id) AS n_pending, title, last_write, n_pages > 0 AS can_finish FROM base b)"""


@register(f"WITH {COUNTS} SELECT archive_id, n_pages, n_discovered, n_assets, n_routes, n_posts, n_failures, n_pending, title, can_finish FROM summary")
def replay_summary(spark, sf_dir):
    """ST-06, AG-12, AG-20, CP-08: what a recovered capture holds."""
    return replay.summary(records(spark, sf_dir)).drop("last_write")


@register(f"""WITH {COUNTS} SELECT f.archive_id, kind, norm AS message FROM failed f JOIN summary s ON f.archive_id = s.archive_id AND can_finish
UNION ALL SELECT archive_id, 'cancelled', 'Capture was interrupted before finishing; ' || n_pending || ' discovered page(s) were never captured.' FROM summary WHERE can_finish AND n_pending > 0""")
def recovery_finish(spark, sf_dir):
    """CP-11, ST-07: the failures of captures finished as they are."""
    return replay.finished(records(spark, sf_dir))


@register(f"WITH {COUNTS} SELECT archive_id, n_pages FROM summary WHERE archive_id % 6 <> 0 AND archive_id % 4 <> 1")
def recovery_list(spark, sf_dir):
    """SRC-11, SL-08: captures with a whole sidecar, newest write first."""
    every = records(spark, sf_dir)
    metas = every.select("archive_id").distinct().select("archive_id", F.when(F.col("archive_id") % 6 == 0, 2).otherwise(1).alias("version"), F.when(F.col("archive_id") % 4 != 1, "https://x.example/").alias("start_url"))
    return replay.recoverable(metas, every).select("archive_id", "n_pages")


STAGED = "CAST(user_id AS VARCHAR) AS dir, CAST(round(value * 1000) AS BIGINT) AS size, ts AS mtime, event_type = 'purchase' AS checkpoint"


@register(f"""WITH f AS (SELECT {STAGED} FROM events), d AS (SELECT dir, CAST(sum(size) AS BIGINT) AS n_bytes, max(mtime) AS newest, bool_or(checkpoint) AS checkpoint FROM f GROUP BY dir),
i AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(newest)) / 3600000000 AS idle FROM d) SELECT dir, n_bytes, newest, idle >= 1 AND NOT (idle < 168 AND checkpoint) AS sweep FROM i""")
def staging_sweep(spark, sf_dir):
    """SRC-24, PF-33, AG-11, ST-13: staging folders, their sizes and which a sweep removes."""
    files = views.table(spark, sf_dir, "events").selectExpr(*_split(STAGED.replace("VARCHAR", "STRING")))
    return replay.swept(files, "2024-01-31 00:00:00")


@register(f"WITH {sql.ARCHIVES} SELECT DISTINCT user_id AS archive_id FROM events WHERE user_id NOT IN (SELECT id FROM archives WHERE id % 2 = 0)")
def interrupted_sweep(spark, sf_dir):
    """JN-12, ST-13: captures that were started and left no archive."""
    return replay.without_archive(views.journal(spark, sf_dir), views.archives(spark, sf_dir).where("id % 2 = 0"))


# Library: lookups, changes, transfer


@register(f"WITH {sql.ARCHIVES} SELECT id, EXISTS (SELECT 1 FROM archives a WHERE a.id = w.id AND NOT deleted) AS active, EXISTS (SELECT 1 FROM archives a WHERE a.id = w.id) AS known FROM (SELECT DISTINCT event_id AS id FROM events) w")
def library_lookup(spark, sf_dir):
    """PF-06: which ids have an active row, and which any row."""
    rows = views.archives(spark, sf_dir).select(F.col("id").alias("_id"), "deleted")
    asked = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id")).distinct()
    return asked.join(rows, asked["id"] == rows["_id"], "left").select("id", F.coalesce(~F.col("deleted"), F.lit(False)).alias("active"), F.col("_id").isNotNull().alias("known"))


@register(f"WITH {sql.ARCHIVES} SELECT domain, id FROM archives WHERE NOT deleted")
def library_ids_by_domain(spark, sf_dir):
    """PF-07: active ids of each domain."""
    return active(spark, sf_dir).select("domain", "id")


@register(f"WITH {sql.ARCHIVES} SELECT id, sort, place FROM (SELECT id, 'oldest' AS sort, row_number() OVER (PARTITION BY domain ORDER BY visited_at, id) AS place FROM archives WHERE NOT deleted UNION ALL SELECT id, 'size', row_number() OVER (PARTITION BY domain ORDER BY size_bytes DESC, id) FROM archives WHERE NOT deleted UNION ALL SELECT id, 'newest', row_number() OVER (PARTITION BY domain ORDER BY visited_at DESC, id) FROM archives WHERE NOT deleted)")
def library_sorts(spark, sf_dir):
    """SL-01: places under every sort mode, within a domain."""
    from pyspark.sql import Window

    rows, out = active(spark, sf_dir), None
    for mode in ("oldest", "size", "newest"):
        one = rows.select("id", F.lit(mode).alias("sort"), F.row_number().over(Window.partitionBy("domain").orderBy(*catalog.sort_columns(mode))).cast("long").alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


@register(f"WITH {sql.ARCHIVES}, p AS (SELECT domain FROM archives WHERE NOT deleted ORDER BY visited_at DESC, id LIMIT 50) SELECT DISTINCT domain FROM p")
def page_domains(spark, sf_dir):
    """AG-14: domains of the current page of results."""
    return catalog.LibraryQuery().page(views.archives(spark, sf_dir)).select("domain").distinct()


@register(f"WITH {sql.ARCHIVES} SELECT id, title, CASE WHEN id % 3 <> 0 THEN sha256(body) END AS text_sha256 FROM archives")
def schema_migration(spark, sf_dir):
    """SRC-02: rows of the older schema, without hashes, under those of the newer."""
    rows = views.archives(spark, sf_dir)
    new = rows.where("id % 3 <> 0").select("id", "title", F.sha2("body", 256).alias("text_sha256"))
    return library.migrated(rows.where("id % 3 = 0").select("id", "title"), new)


CHANGES = """changes AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'view' THEN 'title' WHEN 'click' THEN 'tags' WHEN 'purchase' THEN 'size' WHEN 'error' THEN 'delete' ELSE 'status' END AS op,
  CASE event_type WHEN 'view' THEN 'Title ' || event_id WHEN 'click' THEN '["a","t' || event_id || '"]' WHEN 'purchase' THEN CAST(event_id AS VARCHAR) WHEN 'error' THEN '1' ELSE 'failed' END AS value FROM events WHERE event_type <> 'error' OR event_id % 3 = 0)"""
AFTER = f"""{sql.ARCHIVES}, {CHANGES}, o AS (SELECT id, arg_max(value, seq) FILTER (op = 'title') AS t, arg_max(value, seq) FILTER (op = 'tags') AS g, arg_max(value, seq) FILTER (op = 'size') AS z, arg_max(value, seq) FILTER (op = 'status') AS s,
  count(*) FILTER (op = 'delete') AS d FROM changes GROUP BY id), after AS (SELECT a.id, coalesce(o.t, a.title) AS title, coalesce(o.g, '[]') AS tags, coalesce(CAST(o.z AS BIGINT), a.size_bytes) AS size_bytes, coalesce(o.s, a.status) AS status, a.deleted OR coalesce(o.d, 0) > 0 AS deleted FROM archives a LEFT JOIN o ON a.id = o.id)"""


def after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.expr("CASE event_type WHEN 'view' THEN 'title' WHEN 'click' THEN 'tags' WHEN 'purchase' THEN 'size' WHEN 'error' THEN 'delete' ELSE 'status' END")
    e = F.col("event_id").cast("string")
    value = F.when(op == "title", F.concat(F.lit("Title "), e)).when(op == "tags", F.to_json(F.array(F.lit("a"), F.concat(F.lit("t"), e)))).when(op == "size", e).when(op == "delete", "1").otherwise("failed")
    changes = views.table(spark, sf_dir, "events").where("event_type <> 'error' or event_id % 3 = 0").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), op.alias("op"), value.alias("value"))
    return library.changed(views.archives(spark, sf_dir).withColumn("tags", F.lit("[]")), changes)


@register(f"WITH {AFTER} SELECT * FROM after")
def library_changes(spark, sf_dir):
    """DM-02, DM-03: renames, tags, sizes, statuses and soft deletes, the last of each."""
    return after_changes(spark, sf_dir).select("id", "title", "tags", "size_bytes", "status", "deleted")


@register(f"WITH {AFTER} SELECT id, title FROM after WHERE NOT deleted")
def index_after_changes(spark, sf_dir):
    """DM-01, FT-09: the index follows inserts, renames and deletes."""
    return library.indexed(after_changes(spark, sf_dir)).select("id", "title")


@register(f"WITH {AFTER} SELECT id, CAST(len(CAST(json_extract_string(tags, '$[*]') AS VARCHAR[])) AS INTEGER) AS n_tags, coalesce(json_extract_string(tags, '$[1]'), '') AS second FROM after")
def tags_decoded(spark, sf_dir):
    """SC-J01, PF-01: tags as JSON text and back."""
    tags = F.from_json("tags", "array<string>")
    return after_changes(spark, sf_dir).select("id", F.size(tags).alias("n_tags"), F.coalesce(F.get(tags, F.lit(1)), F.lit("")).alias("second"))


@register(f"WITH {sql.ARCHIVES}, d AS (SELECT DISTINCT domain FROM archives WHERE NOT deleted AND id % 2 = 0) SELECT id, deleted OR domain IN (SELECT domain FROM d) AS deleted FROM archives")
def library_clear(spark, sf_dir):
    """DM-05: everything of the chosen domains is deleted."""
    rows = views.archives(spark, sf_dir)
    return library.deleted_by_domain(rows, rows.where("not deleted and id % 2 = 0")).select("id", "deleted")


@register(f"WITH {sql.ARCHIVES} SELECT id, visited_at, id % 3 <> 0 AND id % 5 <> 0 AS has_text, id % 4 = 0 AND id % 7 <> 0 AS has_favicon FROM archives WHERE NOT deleted")
def library_export(spark, sf_dir):
    """SRC-03, SRC-20, PF-03, JN-16, SL-09: active rows, oldest first, claiming only files that are there."""
    rows = views.archives(spark, sf_dir).withColumn("has_text", F.col("id") % 3 != 0).withColumn("favicon_path", F.when(F.col("id") % 4 == 0, "favicon.png"))
    files = rows.where("id % 5 <> 0").select("id", F.lit("text.txt").alias("name")).unionByName(rows.where("id % 7 <> 0").select("id", F.lit("favicon.png").alias("name")))
    return library.exported(rows, files).drop("favicon_path")


UID = "concat(substring({h}, 1, 8), '-', substring({h}, 9, 4), '-', substring({h}, 13, 4), '-', substring({h}, 17, 4), '-', substring({h}, 21, 12))"
ENTRY = """CASE WHEN doc_id % 11 = 0 THEN concat('../', CAST(doc_id AS STRING)) ELSE {uid} END AS id, concat('https://x.example/', CAST(doc_id AS STRING)) AS canonical_url, CASE WHEN doc_id % 17 <> 0 THEN source END AS title,
  CASE WHEN doc_id % 13 = 0 THEN 'odd' ELSE 'success' END AS status, doc_id AS size, doc_id % 2 = 0 AS has_text, CASE WHEN doc_id % 5 = 0 THEN 'bad' WHEN doc_id % 7 <> 0 THEN {sha} END AS text_sha256, CASE WHEN doc_id % 6 <> 4 THEN text END AS content, doc_id % 3 AS n_warnings, {uid} AS uid, doc_id"""
ENTRIES = f"entries AS (SELECT {ENTRY.format(uid=UID.format(h='md5(CAST(doc_id AS VARCHAR))'), sha='sha256(text)').replace('STRING', 'VARCHAR')} FROM documents)"
OUTCOMES = f"""{ENTRIES}, o AS (SELECT *, CASE WHEN doc_id % 11 = 0 OR title IS NULL OR status = 'odd' THEN 'failed' WHEN doc_id % 4 = 3 THEN 'skipped' ELSE 'imported' END AS outcome,
  has_text AND content IS NOT NULL AND (text_sha256 IS NULL OR sha256(content) = text_sha256) AS ok FROM entries),
outcomes AS (SELECT id, outcome, outcome = 'imported' AND ok AS has_text, CAST(CASE WHEN outcome = 'imported' AND ok THEN strlen(content) ELSE 0 END AS BIGINT) AS size_bytes,
  CAST(CASE WHEN outcome = 'imported' THEN n_warnings + CASE WHEN has_text AND NOT ok THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS n_warnings FROM o)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ENTRY.format(uid=UID.format(h="md5(cast(cast(doc_id as string) as binary))"), sha="sha2(text, 256)")
    entries = views.table(spark, sf_dir, "documents").selectExpr(*_split(columns)).withColumn("tags", F.array().cast("array<string>"))
    return library.import_outcomes(entries.drop("doc_id", "uid"), entries.where("doc_id % 4 = 3").select(F.col("uid").alias("id")))


@register(f"WITH {OUTCOMES} SELECT * FROM outcomes")
def library_import(spark, sf_dir):
    """SRC-21, PF-29, PF-36, JN-07, DM-11, CP-13: untrusted entries checked, skipped, verified."""
    return outcomes(spark, sf_dir)


@register(f"WITH {OUTCOMES} SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def import_counts(spark, sf_dir):
    """AG-15: how many entries were imported, skipped and failed."""
    return outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


HISTORY = f"""{RECORDS}, captures AS (SELECT archive_id, max(ts) AS captured_at, count(*) FILTER (t = 'page') AS n_pages, count(*) FILTER (t = 'failure') AS n_failures FROM records GROUP BY archive_id),
history AS (SELECT c.*, (SELECT arg_min(message, seq) FROM records r WHERE r.archive_id = c.archive_id AND t = 'failure' AND kind = 'stopped-at-limit') AS incomplete_reason, archive_id % 2 = 0 AS file_exists FROM captures c)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = records(spark, sf_dir)
    captures = every.groupBy("archive_id").agg(F.max("ts").alias("captured_at"), F.count_if(F.col("t") == "page").alias("n_pages"), F.count_if(F.col("t") == "failure").alias("n_failures"))
    return library.history(captures, every.where("t = 'failure'"), every.where("archive_id % 2 = 0"))


@register(f"WITH {HISTORY} SELECT *, incomplete_reason IS NULL AS complete FROM history")
def history_list(spark, sf_dir):
    """PF-02, PF-26, AG-16, SL-06: captures, newest first, with what stopped them and whether their file is there."""
    return history(spark, sf_dir)


@register(f"WITH {HISTORY} SELECT archive_id, n_pages FROM history WHERE archive_id % 5 <> 0 UNION ALL SELECT id, 1 FROM (SELECT DISTINCT page_id AS id FROM pages) WHERE id NOT IN (SELECT archive_id FROM history WHERE archive_id % 5 <> 0)")
def history_backfill(spark, sf_dir):
    """DM-08, JN-17: removed rows go, captures that the history lacks come in."""
    kept = history(spark, sf_dir).select("archive_id", "n_pages")
    kept = kept.join(kept.where("archive_id % 5 = 0").select("archive_id"), "archive_id", "left_anti")
    return library.backfilled(kept, views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("archive_id"), F.lit(1).cast("long").alias("n_pages")).distinct())


EXCLUDED = (" Example.NET ", "", "  ", "org")
STATUS_URL = "CASE WHEN page_id % 8 = 5 THEN concat('ftp://x.example/', CAST(page_id AS STRING)) ELSE url END"


@register(f"""WITH p AS (SELECT page_id, {STATUS_URL.replace('STRING', 'VARCHAR')} AS u FROM pages), d AS (SELECT *, {sql.host('u')} AS d FROM p)
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'skipped-private' WHEN NOT {sql.is_http('u')} THEN 'skipped-non-http' WHEN page_id % 7 = 0 OR page_id % 31 = 0 OR d = 'example.net' OR d LIKE '%.example.net' OR d = 'org' OR d LIKE '%.org' THEN 'skipped-excluded' END AS status FROM d""")
def capture_eligibility(spark, sf_dir):
    """PF-09, PF-10, PF-37: the first reason against a capture."""
    rows = views.table(spark, sf_dir, "pages").withColumn("url", F.expr(STATUS_URL))
    i = F.col("page_id")
    status = library.capture_status(F.col("url"), i % 9 == 0, i % 7 == 0, i % 31 != 0, library.domain_excluded(urls.host(F.col("url")), EXCLUDED))
    return rows.select("page_id", status.alias("status"))


@register(f"WITH d AS (SELECT DISTINCT {sql.host('url')} AS domain FROM pages) SELECT domain, CASE WHEN domain = 'a.example' THEN 'a.example' ELSE 'a.example,' || domain END AS excluded FROM d")
def exclusion_added(spark, sf_dir):
    """CP-23: a domain added to the excluded ones once."""
    rows = views.table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("domain")).distinct()
    return rows.select("domain", F.array_join(library.with_excluded(F.array(F.lit("a.example")), F.concat(F.lit(" "), F.upper("domain"))), ",").alias("excluded"))


@register(f"SELECT page_id, {sql.host('url')} = 'example.org' OR {sql.host('url')} LIKE '%.example.org' AS under, {sql.scheme('url')} IN ('http', 'https') AS remote, page_id % 3 = 0 OR {sql.scheme('url')} IN ('http', 'https') AS external FROM pages")
def url_safety(spark, sf_dir):
    """PF-12, PF-22: hosts under another, and schemes that may be opened."""
    url = F.col("url")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("MAILTO:a@"), urls.host(url))).otherwise(url)
    return views.table(spark, sf_dir, "pages").select("page_id", urls.same_host_or_under(url, F.lit("example.org")).alias("under"), urls.is_safe_remote(url).alias("remote"), urls.is_safe_external(given).alias("external"))


@register("""WITH a AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS visited_at, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders),
c AS (SELECT * FROM a ORDER BY visited_at, id LIMIT 10000), late AS (SELECT id FROM c WHERE visited_at < '1992-03-31T00:00:00.000Z'),
r AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM late)), f AS (SELECT *, coalesce(sum(size) OVER (ORDER BY visited_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM (SELECT * FROM r ORDER BY visited_at, id LIMIT 10000))
SELECT id, 'retention' AS why FROM late UNION ALL SELECT id, 'quota' FROM f, (SELECT sum(size) AS total FROM r) WHERE total - freed > 20000000""")
def storage_policies(spark, sf_dir):
    """CP-14, DM-09, DM-10, SC-D02: retention by days, then the quota on what is left."""
    items = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", views.STAMP).alias("visited_at"), F.round("o_totalprice").cast("long").alias("size"))
    return library.policies(items, F.lit("1992-04-30 00:00:00").cast("timestamp"), 30, 20_000_000)


SCOPE = """o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 60 - 5 END AS max_depth, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey * 1000 END AS max_pages,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(round(o_totalprice) AS BIGINT) * 1000000 END AS max_bytes, o_custkey % 12 - 2 AS concurrency, CAST(round(o_totalprice) AS BIGINT) - 1000 AS delay_ms"""
CLAMP = "CASE WHEN {c} IS NOT NULL THEN greatest({lo}, least({c}, {hi})) END AS {c}"


@register(f"""WITH s AS (SELECT {SCOPE} FROM orders), c AS (SELECT id, {CLAMP.format(c='max_depth', lo=0, hi=25)}, {CLAMP.format(c='max_pages', lo=1, hi=50000)}, {CLAMP.format(c='max_bytes', lo=1048576, hi=68719476736)}, greatest(1, least(concurrency, 6)) AS concurrency, greatest(0, least(delay_ms, 10000)) AS delay_ms FROM s)
SELECT *, max_depth IS NULL OR max_pages IS NULL OR max_bytes IS NULL OR max_depth > 5 OR max_pages > 200 OR max_bytes > 536870912 AS soft, coalesce(CAST(max_pages AS VARCHAR), 'unlimited') || ' pages' AS said,
CASE WHEN delay_ms >= 60000 THEN 'x' ELSE (delay_ms // 1000) || 's' END AS took FROM c""")
def scope_clamped(spark, sf_dir):
    """SL-13, PF-32, SC-S05: limits of a capture held within bounds, soft limits, and how they are shown."""
    scopes = views.table(spark, sf_dir, "orders").selectExpr(*_split(SCOPE)).withColumn("domains", F.array(F.lit("a.example")))
    rows = library.clamped_scope(scopes).drop("domains")
    d, p, b = (F.col(c) for c in ("max_depth", "max_pages", "max_bytes"))
    return rows.select("*", library.beyond_soft_limits(d, p, b).alias("soft"), library.described_limit(p, "pages").alias("said"), library.duration(F.col("delay_ms")).alias("took"))


@register("SELECT o_orderkey AS id, CASE WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS took FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS s FROM orders)")
def durations(spark, sf_dir):
    """SC-S05: milliseconds as minutes and seconds."""
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), library.duration(F.col("o_totalprice")).alias("took"))


@register("""WITH i AS (SELECT o_orderkey AS id, greatest(1, least(CAST(ceil(o_totalprice / 50) AS BIGINT), 2400)) AS width, greatest(1, least(CAST(o_custkey AS BIGINT) * 97, 12000)) AS height, greatest(1.0, (o_orderkey % 4) * 0.75) AS dsf FROM orders),
e AS (SELECT *, least(1.0::DOUBLE, 16000 / (height * dsf::DOUBLE), 16000 / (width * dsf::DOUBLE), sqrt(32000000 / (width * height * dsf::DOUBLE * dsf::DOUBLE))) AS exact FROM i), s AS (SELECT *, greatest(0.01::DOUBLE, floor(exact * 1000) / 1000) AS scale FROM e)
SELECT id, width, height, scale, CAST(floor(width * scale * dsf::DOUBLE + 0.5) AS BIGINT) AS device_width, CAST(floor(height * scale * dsf::DOUBLE + 0.5) AS BIGINT) AS device_height FROM s""")
def capture_fitted(spark, sf_dir):
    """SC-M01: the size and scale of a capture within its budget."""
    rows = views.table(spark, sf_dir, "orders")
    fit = library.fitted(F.col("o_totalprice") / 50, F.col("o_custkey").cast("long") * 97, (F.col("o_orderkey") % 4) * 0.75)
    return rows.select(F.col("o_orderkey").alias("id"), fit.alias("f")).select("id", F.col("f.width").cast("long").alias("width"), F.col("f.height").cast("long").alias("height"), "f.scale", "f.device_width", "f.device_height")


RAW = """CASE WHEN c_custkey % 7 = 0 THEN '{{not json' WHEN c_custkey % 3 = 0 THEN '{{}}' ELSE concat('{{"captureDelayMs": ', CAST(c_custkey AS {s}), ', "permissionDefaults": {{"camera": "ask", "x": "', c_mktsegment, '"}}}}') END"""


@register(f"""WITH r AS (SELECT c_custkey AS id, c_mktsegment AS m, c_custkey % 7 = 0 OR c_custkey % 3 = 0 AS plain FROM customer)
SELECT id, true AS automatic, CASE WHEN plain THEN 3000 ELSE id END AS delay_ms, 'deny' AS notifications, CASE WHEN plain THEN 'deny' ELSE 'ask' END AS camera, CASE WHEN plain THEN NULL ELSE m END AS own FROM r""")
def settings_merged(spark, sf_dir):
    """SRC-17, SC-A03: user settings over defaults; broken text gives the defaults."""
    raw = F.expr(RAW.format(s="STRING"))
    got = library.merged_settings(raw, {"autoCaptureEnabled": True, "captureDelayMs": 3000}, {"notifications": "deny", "camera": "deny"})
    p = F.col("s.permissionDefaults")
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), got.alias("s")).select(
        "id", F.col("s.autoCaptureEnabled").alias("automatic"), F.col("s.captureDelayMs").alias("delay_ms"), p["notifications"].alias("notifications"), p["camera"].alias("camera"), p["x"].alias("own")
    )


@register(f"WITH {RECORDS}, f AS (SELECT archive_id, seq, kind, row_number() OVER (PARTITION BY archive_id ORDER BY seq) AS r FROM records WHERE t = 'failure') SELECT archive_id, seq, kind FROM f WHERE r <= 50")
def failures_shown(spark, sf_dir):
    """SL-11: the first 50 failures of each capture."""
    from pyspark.sql import Window

    rows = records(spark, sf_dir).where("t = 'failure'").select("archive_id", "seq", "kind")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("archive_id").orderBy("seq"))).where("r <= 50").drop("r")


# Container


PAGE = f"""SELECT page_id, url, {sql.normalize('url')} AS norm, CASE WHEN page_id % 3 = 0 THEN 'https://old.example/' || page_id END AS old FROM pages"""
ROUTES = f"""pg AS ({PAGE}), every AS (SELECT norm, page_id AS seq, 'page' AS type, CAST(page_id AS VARCHAR) AS target FROM pg UNION ALL SELECT old, page_id, 'page', CAST(page_id AS VARCHAR) FROM pg WHERE old IS NOT NULL
  UNION ALL SELECT norm, page_id + 1000000, 'asset', sha256(CAST(page_id AS VARCHAR)) FROM pg WHERE page_id % 10 = 0 UNION ALL SELECT norm, page_id + 2000000, 'response', sha256(CAST(page_id AS VARCHAR)) FROM pg WHERE page_id % 40 = 0),
routes AS (SELECT norm, arg_max(type, seq) AS type, arg_max(target, seq) AS target FROM every GROUP BY norm)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    rows = views.table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm"), F.when(i % 3 == 0, F.array(F.concat(F.lit("https://old.example/"), i.cast("string")))).alias("redirects"), i.alias("seq"))
    sha = F.sha2(i.cast("string"), 256)
    other = lambda n, at, kind: rows.where(i % n == 0).select("norm", (i + at).alias("seq"), F.lit(kind).alias("type"), sha.alias("target"))
    return archive.last_routes(archive.page_routes(rows).unionByName(other(10, 1_000_000, "asset")).unionByName(other(40, 2_000_000, "response")))


@register(f"WITH {ROUTES} SELECT * FROM routes")
def archive_routes(spark, sf_dir):
    """CP-05, CP-06, JN-05: routes of pages, their redirects, assets and responses; the last write wins."""
    return routes(spark, sf_dir)


@register(f"""WITH {ROUTES}, {sql.LINKS.replace('links AS', 'all_links AS')}, l AS (SELECT page_id, pos, url, {sql.normalize('url')} AS norm FROM all_links)
SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN type = 'page' THEN '/page/' || target || regexp_extract(url, '(#.*)$', 1) WHEN type = 'asset' THEN '/assets/' || target || '.bin' ELSE '/__unavailable__?url=' || url_encode(url) END AS local
FROM l LEFT JOIN routes r ON l.norm = r.norm""")
def link_targets(spark, sf_dir):
    """JN-04, JN-15, SC-U13: where the archive leads every link, with its fragment."""
    links = views.links(spark, sf_dir).withColumn("norm", urls.normalize(F.col("url")))
    path = F.concat(F.lit("assets/"), F.col("target"), F.lit(".bin"))
    return links.join(routes(spark, sf_dir), "norm", "left").select("page_id", "pos", archive.link_target(F.col("url"), F.col("type"), F.col("target"), F.when(F.col("type") == "asset", path)).alias("local"))


@register(rf"""WITH {ROUTES}, parts AS (SELECT page_id, url AS page_url, string_split_regex(html, '(?i)<a\b[^>]*?href="[^"]*"[^>]*>') AS between, regexp_extract_all(html, '(?i)<a\b[^>]*?href="[^"]*"[^>]*>') AS tags FROM pages),
e AS (SELECT page_id, page_url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM parts), h AS (SELECT *, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href FROM e), l AS (SELECT *, {sql.resolve('href', 'page_url')} AS url FROM h),
n AS (SELECT *, {sql.normalize('url')} AS nrm FROM l), t AS (SELECT n.page_id, pos, CASE WHEN href = '' OR href LIKE '#%' OR NOT regexp_matches(url, '(?i)^https?:') THEN tag ELSE regexp_extract(tag, '(?i)^(.*?)href="', 1) || 'href="' ||
  CASE WHEN type = 'page' THEN '/page/' || target || regexp_extract(url, '(#.*)$', 1) WHEN type = 'asset' THEN '/assets/' || target || '.bin' ELSE '/__unavailable__?url=' || url_encode(url) END || '" data-archive-original-href="' ||
  replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"' || regexp_extract(tag, '(?i)href="[^"]*"(.*)$', 1) END AS new FROM n LEFT JOIN routes r ON n.nrm = r.norm),
m AS (SELECT page_id, list(new ORDER BY pos) AS news FROM t GROUP BY page_id)
SELECT p.page_id, sha256(array_to_string(list_transform(between, lambda b, i: b || coalesce(news[i], '')), '')) AS html_sha256 FROM parts p LEFT JOIN m ON p.page_id = m.page_id""")
def rewritten_html(spark, sf_dir):
    """UD-07: pages whose links lead into the archive."""
    to = routes(spark, sf_dir).withColumn("asset_path", F.when(F.col("type") == "asset", F.concat(F.lit("assets/"), F.col("target"), F.lit(".bin"))))
    return archive.rewritten_pages(views.table(spark, sf_dir, "pages"), to).select("page_id", F.sha2("html", 256).alias("html_sha256"))


@register(f"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 4 = 1 THEN 'https://elsewhere.example/' || page_id ELSE url END AS final_url FROM pages), n AS (SELECT *, {sql.normalize('final_url')} AS norm FROM p), c AS (SELECT DISTINCT {sql.normalize('url')} AS norm FROM pages WHERE page_id % 2 = 0)
SELECT page_id, CASE WHEN norm IN (SELECT norm FROM c) THEN 'skipped-duplicate' WHEN {sql.origin('final_url')} <> {sql.origin('url')} THEN 'out-of-scope' ELSE 'captured' END AS outcome FROM n""")
def redirect_outcomes(spark, sf_dir):
    """PF-28, JN-19: where redirects lead: to a page that is there, out of scope, or to a new page."""
    rows = views.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("start_url"), F.expr("CASE WHEN page_id % 4 = 1 THEN concat('https://elsewhere.example/', CAST(page_id AS STRING)) ELSE url END").alias("final_url"))
    return archive.redirect_outcomes(rows, views.table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.col("url").alias("final_url")))


@register(f"WITH p AS (SELECT *, {sql.host('url')} AS archive_id FROM pages), s AS (SELECT archive_id, max(url) FILTER (page_id % 2 = 0) AS start_url FROM p GROUP BY archive_id) SELECT p.archive_id, arg_min(page_id, (CASE WHEN url = start_url THEN 0 ELSE 1000000000 END) + page_id) AS page_id FROM p JOIN s ON p.archive_id = s.archive_id GROUP BY p.archive_id")
def entry_pages(spark, sf_dir):
    """WN-10: the page that an archive opens with."""
    rows = views.table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("archive_id"), "page_id", F.col("page_id").alias("seq"), "url")
    start = rows.groupBy("archive_id").agg(F.max(F.when(F.col("page_id") % 2 == 0, F.col("url"))).alias("start_url"))
    both = rows.join(start, "archive_id").withColumn("start_url", F.coalesce("start_url", F.lit("")))
    return archive.entry_pages(both)


MANIFEST = """CASE WHEN page_id % 7 = 1 THEN '{{oops' ELSE concat('{{"formatVersion": ', CASE WHEN page_id % 7 = 2 THEN '2' ELSE '1' END, CASE WHEN page_id % 7 = 3 THEN '' ELSE concat(', "archiveId": "a', CAST(page_id AS {s}), '"') END,
  ', "pages": [{{"pageId": "', CAST(page_id AS {s}), '", "htmlPath": "', CASE WHEN page_id % 7 = 4 THEN '../up.html' ELSE 'pages/1.html' END, '"', CASE WHEN page_id % 7 = 5 THEN '' ELSE ', "htmlSha256": "00"' END, '}}], "assets": [{{"sha256": "ff", "path": "assets/ff.png"}}], "routes": [], "responses": [], "failures": ', CASE WHEN page_id % 14 = 6 THEN '3' ELSE '[]' END, '}}') END"""


@register("SELECT page_id AS id, CASE WHEN page_id % 7 IN (1, 3, 5) OR page_id % 14 = 6 THEN 'malformed-manifest' WHEN page_id % 7 = 2 THEN 'unsupported-version' WHEN page_id % 7 = 4 THEN 'unsafe-path' ELSE 'ok' END AS code FROM pages")
def manifest_checked(spark, sf_dir):
    """SRC-07, CP-12: manifests checked field by field."""
    rows = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.expr(MANIFEST.format(s="STRING")).alias("manifest"))
    return archive.checked_manifests(rows).select("id", "code")


@register("SELECT page_id AS id, path FROM pages, (SELECT unnest(['pages/1.html', 'assets/ff.png', '../up.html', 'extra.txt']) AS path) WHERE page_id % 7 <> 1 AND (path = 'assets/ff.png' OR path = CASE WHEN page_id % 7 = 4 THEN '../up.html' ELSE 'pages/1.html' END)")
def manifest_entries(spark, sf_dir):
    """JN-14, SC-A01: entries that their manifest names."""
    rows = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.expr(MANIFEST.format(s="STRING")).alias("manifest"))
    entries = rows.select("id", F.explode(F.array(*[F.lit(p) for p in ("pages/1.html", "assets/ff.png", "../up.html", "extra.txt")])).alias("path"))
    return archive.owned_entries(entries, rows)


ASKED = "CASE page_id % 6 WHEN 0 THEN concat('page/', CAST(page_id AS {s})) WHEN 1 THEN concat('text/', CAST(page_id AS {s})) WHEN 2 THEN concat('assets/', {sha}, '.PNG') WHEN 3 THEN '__unavailable__?url=x' WHEN 4 THEN 'page/../etc' ELSE 'page/none' END"


@register("""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'page' WHEN page_id % 6 = 1 AND page_id % 4 <> 1 THEN 'text' WHEN page_id % 6 = 2 AND page_id % 5 <> 0 THEN 'asset' WHEN page_id % 6 = 3 THEN 'unavailable' ELSE 'missing' END AS found,
CASE WHEN page_id % 6 IN (0, 3) THEN 'text/html; charset=utf-8' WHEN page_id % 6 = 2 AND page_id % 5 <> 0 THEN 'image/png' ELSE 'text/plain; charset=utf-8' END AS content_type FROM pages""")
def served_entries(spark, sf_dir):
    """SRC-27, SRC-28, CP-18, CP-19: what paths inside an archive lead to, and their content types."""
    rows = views.table(spark, sf_dir, "pages")
    sha = F.sha2(F.col("page_id").cast("string"), 256)
    asked = rows.select("page_id", F.expr(ASKED.format(s="STRING", sha="sha2(cast(page_id as string), 256)")).alias("path"))
    assets = rows.where("page_id % 5 <> 0").select(sha.alias("sha256"), F.concat(F.lit("assets/"), sha, F.lit(".png")).alias("path"))
    return archive.served(asked, rows.select("page_id", (F.col("page_id") % 4 != 1).alias("has_text")), assets).select("page_id", "found", "content_type")


@register("""WITH b AS (SELECT turn AS url, text, conv_id * 1000 + turn AS seq FROM conversations), o AS (SELECT sha256(text) AS sha256, url, min(seq) AS seq FROM b GROUP BY ALL)
SELECT sha256, arg_min(url, seq) AS first_url, string_agg(url, ',' ORDER BY seq) AS sources FROM o GROUP BY sha256""")
def asset_source_lists(spark, sf_dir):
    """AG-08: per content all its URLs, each once, in order of the first write."""
    blobs = views.table(spark, sf_dir, "conversations").select(F.col("turn").alias("url"), F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return archive.asset_sources(blobs).withColumn("sources", F.array_join("sources", ","))


@register("SELECT sha256(text) AS sha256, arg_min(conv_id || '/' || turn, conv_id * 1000 + turn) AS url, CAST(any_value(strlen(text)) AS BIGINT) AS n_bytes FROM conversations GROUP BY 1")
def response_dedup(spark, sf_dir):
    """AG-09: the first response of each content."""
    blobs = views.table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("url"), F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return archive.first_responses(blobs)


@register("""WITH p AS (SELECT 'html' AS kind, CAST(page_id AS VARCHAR) AS key, strlen(html) AS size FROM pages UNION ALL SELECT 'post', conv_id || '#' || turn, strlen(text) FROM conversations UNION ALL SELECT 'text', sha256(text), strlen(text) FROM documents WHERE text IS NOT NULL),
o AS (SELECT kind, key, any_value(size) AS size FROM p GROUP BY ALL) SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM o GROUP BY kind""")
def container_bytes(spark, sf_dir):
    """AG-10: bytes of what a container holds, each content once."""
    pages, posts_, docs = (views.table(spark, sf_dir, t) for t in ("pages", "conversations", "documents"))
    size = lambda c: F.octet_length(c).cast("long").alias("size")
    parts = pages.select(F.lit("html").alias("kind"), F.col("page_id").cast("string").alias("key"), size("html"))
    parts = parts.unionByName(posts_.select(F.lit("post").alias("kind"), F.concat_ws("#", "conv_id", "turn").alias("key"), size("text")))
    return archive.byte_totals(parts.unionByName(docs.where("text is not null").select(F.lit("text").alias("kind"), F.sha2("text", 256).alias("key"), size("text"))))


ICON = """page_id % 2 = 0"""


@register(f"SELECT page_id, CASE WHEN {ICON} THEN {sql.origin('url')} || '/fav' || page_id || '.png' ELSE {sql.origin('url')} || '/favicon.ico' END AS favicon FROM pages")
def favicons(spark, sf_dir):
    """CP-20: the icon that a page names, else the one at its root."""
    named = F.concat("html", F.when(F.expr(ICON), F.concat(F.lit('<link href="/fav'), F.col("page_id").cast("string"), F.lit('.png" rel="shortcut icon">'))).otherwise('<link rel="icons" href="/no.png">'))
    return views.table(spark, sf_dir, "pages").select("page_id", archive.favicon(named, F.col("url")).alias("favicon"))


# Retry


TRIED = f"""{RECORDS}, tried AS (SELECT DISTINCT archive_id || '/' || norm AS norm, CAST(norm AS BIGINT) % 3 = 0 AS ok FROM records WHERE t = 'failure' AND kind <> 'stopped-at-limit'),
p AS (SELECT DISTINCT archive_id || '/' || norm AS norm FROM records WHERE t = 'page'), f AS (SELECT archive_id || '/' || norm || CASE WHEN seq % 5 = 0 THEN '#x' ELSE '' END AS url, kind FROM records WHERE t = 'failure')"""


def retry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = records(spark, sf_dir).withColumn("key", F.concat_ws("/", "archive_id", "norm"))
    pages = every.where("t = 'page'").select(F.col("key").alias("norm")).distinct()
    failed = every.where("t = 'failure'").select(F.concat("key", F.when(F.col("seq") % 5 == 0, "#x").otherwise("")).alias("url"), "kind")
    tried = every.where("t = 'failure' and kind <> 'stopped-at-limit'").select(F.col("key").alias("url"), F.col("key").alias("norm"), (F.col("norm").cast("long") % 3 == 0).alias("ok"), F.lit("timeout").alias("kind")).distinct()
    return archive.retried(pages, failed, tried)


@register(f"WITH {TRIED} SELECT norm FROM p WHERE norm NOT IN (SELECT norm FROM tried) UNION ALL SELECT norm FROM tried WHERE ok")
def retry_pages(spark, sf_dir):
    """CP-09, CP-10, JN-08: pages after a retry."""
    return retry(spark, sf_dir)[0]


@register(f"WITH {TRIED} SELECT url, kind FROM f WHERE url NOT IN (SELECT norm FROM tried) UNION ALL SELECT norm, 'timeout' FROM tried WHERE NOT ok")
def retry_failures(spark, sf_dir):
    """CP-09, JN-08: failures after a retry; one under a URL that isn't normalised stays."""
    return retry(spark, sf_dir)[1]


@register(f"""WITH {sql.LINKS}, f AS (SELECT page_id, pos, url, page_url FROM links), k AS (SELECT {sql.normalize('url')} AS norm, min({sql.thread_key('url')}) AS thread_key FROM pages GROUP BY 1)
SELECT page_id, CAST(pos AS INTEGER) AS pos, thread_key FROM f LEFT JOIN k ON {sql.normalize('f.page_url')} = k.norm""")
def retry_parent_keys(spark, sf_dir):
    """JN-22: retried pages take the keys of the page that led to them."""
    known = views.table(spark, sf_dir, "pages").select(urls.normalize(F.col("url")).alias("norm"), urls.thread_key(F.col("url")).alias("thread_key"), F.lit(None).cast("string").alias("section_key"))
    links = views.links(spark, sf_dir).select("page_id", "pos", urls.normalize(F.col("url")).alias("norm"), urls.normalize(F.col("page_url")).alias("discovered_on"))
    return archive.with_parent_keys(links, known).select("page_id", "pos", "thread_key")


# Search inside an archive, forum posts


INDEX = f"idx AS (SELECT page_id, {sql.title('html')} AS title, {sql.text('html')} AS body FROM pages)"
@register(rf"""WITH {INDEX}, {sql.search('idx', ['th', 'on'], {'title': 1, 'body': 1})}, b AS (SELECT page_id, title, body, score FROM found ORDER BY score, page_id LIMIT 30), {sql.windows('b', 'page_id', 'body', [['th'], ['on']], 12)}
SELECT b.page_id, b.title, {sql.normalize('p.url')} AS norm, coalesce(v.snippet, {sql.snippet('b.body', 'th', 12)}) AS snippet FROM b JOIN pages p ON p.page_id = b.page_id AND b.page_id % 5 <> 0 LEFT JOIN windows v ON v.page_id = b.page_id""")
def search_pages(spark, sf_dir):
    """JN-02, JN-11, FT-07, FT-10, SL-07: the best pages of an archive; hits whose page is gone are dropped."""
    pages = views.archives(spark, sf_dir).withColumnRenamed("id", "page_id")
    known = pages.where("page_id % 5 <> 0").select("page_id", "title", urls.normalize(F.col("final_url")).alias("norm"))
    texts = pages.select("page_id", "title", "body")
    return results.page_results(texts, known, "th on", kept=indexes.pages(texts)).select("page_id", "title", "norm", "snippet")


POSTS = f"""posts AS (SELECT conv_id || '#post-' || turn AS post_id, conv_id AS page_id, role AS author, 'Thread ' || conv_id AS thread, 'https://f.example/t/' || conv_id AS url, text AS body FROM conversations)"""


def archive_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id").cast("string")
    return views.table(spark, sf_dir, "conversations").select(
        F.concat(c, F.lit("#post-"), F.col("turn").cast("string")).alias("post_id"), F.col("conv_id").alias("page_id"), F.col("role").alias("author"), F.concat(F.lit("Thread "), c).alias("thread"), F.concat(F.lit("https://f.example/t/"), c).alias("url"), F.col("text").alias("body")
    )


@register(rf"""WITH {POSTS}, {sql.search('posts', ['assist', 'th'], {'author': 1, 'thread': 1, 'url': 1, 'body': 1})}, b AS (SELECT post_id, page_id, author, thread, url, body, score FROM found ORDER BY score, post_id LIMIT 30), {sql.windows('b', 'post_id', 'body', [['assist'], ['th']], 12)}
SELECT b.post_id, page_id, author, thread, url AS norm, coalesce(v.snippet, {sql.snippet('body', 'assist', 12)}) AS snippet FROM b LEFT JOIN windows v ON v.post_id = b.post_id WHERE page_id % 3 <> 0""")
def search_posts(spark, sf_dir):
    """JN-03, JN-10, FT-05, FT-10: the best posts with their pages; authors match too."""
    rows = archive_posts(spark, sf_dir)
    pages = rows.where("page_id % 3 <> 0").select("page_id", F.col("url").alias("norm")).distinct()
    return results.post_results(rows, rows, pages, "assist th", kept=indexes.archive_posts(rows)).select("post_id", "page_id", "author", "thread", "norm", "snippet")


@register(f"WITH {sql.ARCHIVES} SELECT id, CASE WHEN i % 2 = 0 THEN 'match' ELSE 'plain' END AS kind, part FROM (SELECT id, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (SELECT id, string_split(replace(title, 'e', chr(1) || 'e' || chr(2)), chr(1)) AS a, string_split_regex(replace(title, 'e', chr(1) || 'e' || chr(2)), '[' || chr(1) || chr(2) || ']') AS ps FROM archives)) WHERE part <> ''")
def snippet_marks(spark, sf_dir):
    """SC-S02: a marked snippet as plain and matched parts."""
    from pagestrata.functions import text

    marked = F.replace(F.col("title"), F.lit("e"), F.lit(f"{text.START_MARK}e{text.END_MARK}"))
    parts = views.archives(spark, sf_dir).select("id", F.posexplode(text.snippet_parts(marked)).alias("i", "part"))
    return parts.where("part <> ''").select("id", F.when(F.col("i") % 2 == 1, "match").otherwise("plain").alias("kind"), "part")


POST_HTML = """concat('<article class="message" id="post-', CAST(turn AS {s}), '"><meta itemprop="position" content="', CAST(turn + 100 AS {s}), '">', CASE WHEN turn % 2 = 0 THEN concat('<span itemprop="name">', role, '</span>') ELSE concat('<a href="/members/', role, '/">', role, ' M</a>') END,
  '<time datetime="2024-01-', lpad(CAST(turn % 28 + 1 AS {s}), 2, '0'), '">then</time><header>Head</header><div class="message-body"><blockquote>old</blockquote>', replace(replace({t}, '<', ' '), '>', ' '), '</div></article>')"""


@register("""SELECT conv_id, 'post-' || turn AS anchor, CASE WHEN turn % 2 = 0 THEN role ELSE role || ' M' END AS author, CASE WHEN turn % 2 = 1 THEN '/members/' || role || '/' END AS profile, '2024-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') AS written, CAST(turn + 100 AS INTEGER) AS number,
trim(regexp_replace(replace(replace(coalesce(text, ''), '<', ' '), '>', ' '), '[ \\t\\r\\n]+', ' ', 'g'))[1:20000] AS body FROM conversations""".replace("\\\\", "\\"))
def forum_posts(spark, sf_dir):
    """UD-06, CP-07: the posts of forum pages, twenty a page."""
    made = F.expr(POST_HTML.format(s="STRING", t="coalesce(text, '')"))
    rows = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 20).alias("page"), made.alias("html"))
    pages = rows.groupBy("conv_id", "page").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "html"))), lambda p: p["html"]), ""), F.lit("</body></html>")).alias("html"))
    return pages.select("conv_id", F.explode(posts.posts(F.col("html"))).alias("p")).select("conv_id", "p.*")


@register(f"""WITH p AS (SELECT {sql.normalize('url')} AS norm, CASE WHEN page_id % 2 = 0 THEN {sql.thread_key('url')} END AS t, {sql.host('url')} AS s FROM pages)
SELECT (SELECT count(DISTINCT s) FROM p) AS n_sections, (SELECT count(DISTINCT t) FROM p) AS n_threads, (SELECT count(*) FROM p WHERE t IS NULL AND regexp_matches(norm, '(?i)/(members?|profile|user)/')) AS n_profiles, (SELECT count(*) FROM conversations) AS n_posts, (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) AS n_attachments""")
def forum_totals(spark, sf_dir):
    """AG-06: sections, threads, posts, documents and profiles of a forum."""
    url = F.col("url")
    pages = views.table(spark, sf_dir, "pages").select(urls.normalize(url).alias("norm"), F.when(F.col("page_id") % 2 == 0, urls.thread_key(url)).alias("thread_key"), urls.host(url).alias("section_key"))
    assets = views.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, "document").otherwise("image").alias("kind"))
    return archive.forum_totals(pages, views.table(spark, sf_dir, "conversations"), assets)


@register(f"WITH {sql.LINKS} SELECT page_id, count(DISTINCT url) AS n FROM links WHERE starts_with(url, {sql.origin('page_url')}) GROUP BY page_id")
def page_estimate(spark, sf_dir):
    """AG-13: distinct anchors under a page's origin, before a capture."""
    links = views.links(spark, sf_dir)
    return links.where(F.col("url").startswith(urls.origin(F.col("page_url")))).groupBy("page_id").agg(F.count_distinct("url").alias("n"))


@register("SELECT 'pages' AS entity, count(*) AS n FROM pages UNION ALL SELECT 'routes', count(DISTINCT norm) FROM (" + f"SELECT {sql.normalize('url')} AS norm FROM pages" + ") UNION ALL SELECT 'posts', count(*) FROM conversations")
def index_tables(spark, sf_dir):
    """SRC-19: the entities of an index written as tables and read back."""
    from pagestrata.sources.tables import settle

    pages = views.table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm"))
    tables = {"pages": pages, "routes": pages.select("norm").distinct(), "posts": archive_posts(spark, sf_dir)}
    out = None
    for name, df in tables.items():
        one = settle(df).agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out
