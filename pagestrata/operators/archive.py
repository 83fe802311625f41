"""Routes, manifests, byte totals, lookups and retries of an archive container."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import text, urls

FORMAT_VERSION = 1
# Content types by file extension.
CONTENT_TYPES = {
    "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "text/javascript; charset=utf-8", "json": "application/json; charset=utf-8",
    "txt": "text/plain; charset=utf-8", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif",
    "svg": "image/svg+xml", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "mp4": "video/mp4",
    "mp3": "audio/mpeg", "pdf": "application/pdf",
}
# Links that are rewritten, and profile pages.
LINK = r'(?i)<a\b[^>]*?href="[^"]*"[^>]*>'
PROFILE_URL = r"(?i)/(members?|profile|user)/"
MANIFEST = "struct<formatVersion:double,archiveId:string,pages:array<struct<pageId:string,htmlPath:string,htmlSha256:string,textPath:string>>,assets:array<struct<sha256:string,path:string>>,routes:array<string>,responses:array<string>,failures:array<string>,indexPath:string>"


def page_routes(pages: DataFrame) -> DataFrame:
    """(norm, seq, type, target): the route of each page's URL and of each redirect that led to it (pages: page_id, norm, redirects, seq)."""
    each = F.explode(F.concat(F.array("norm"), F.coalesce("redirects", F.array().cast("array<string>"))))
    return pages.select(each.alias("norm"), "seq", F.lit("page").alias("type"), F.col("page_id").cast("string").alias("target"))


def last_routes(routes: DataFrame) -> DataFrame:
    """(norm, type, target): the last route written per URL, whether to a page, an asset or a response."""
    return routes.groupBy("norm").agg(F.max_by(F.struct("type", "target"), "seq").alias("r")).select("norm", "r.*")


def redirect_outcomes(pages: DataFrame, captured: DataFrame, domains: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, outcome) after redirects (pages: page_id, start_url, final_url): duplicate, out-of-scope or captured."""
    there = captured.select(urls.normalize(F.col("final_url")).alias("norm")).distinct().withColumn("_there", F.lit(True))
    moved = pages.withColumn("norm", urls.normalize(F.col("final_url")))
    away = ~F.coalesce(urls.in_scope(F.col("final_url"), F.col("start_url"), domains), F.lit(False))
    outcome = F.when(F.col("_there"), "skipped-duplicate").when(away, "out-of-scope").otherwise("captured")
    return moved.join(there, "norm", "left").select("page_id", outcome.alias("outcome"))


def entry_pages(pages: DataFrame) -> DataFrame:
    """(archive_id, page_id): the first page that is the start URL's, else the first page (pages: archive_id, seq, page_id, url, start_url)."""
    return pages.groupBy("archive_id").agg(F.min_by("page_id", F.struct(F.col("url") != F.col("start_url"), F.col("seq"))).alias("page_id"))


def link_target(link: Column, kind: Column, target: Column, asset_path: Column) -> Column:
    """Where an archive leads a link: a page with the link's fragment, an asset's path, or the page for what is not there."""
    mark = F.regexp_extract(link, r"(#.*)$", 1)
    gone = F.concat(F.lit("/__unavailable__?url="), text.component(link))
    return F.when(kind == "page", F.concat(F.lit("/page/"), target, mark)).when((kind == "asset") & asset_path.isNotNull(), F.concat(F.lit("/"), asset_path)).otherwise(gone)


def rewritten_pages(pages: DataFrame, routes: DataFrame) -> DataFrame:
    """(page_id, html): pages (page_id, url, html) whose links lead into the archive; routes: norm, type, target, asset_path."""
    parts = pages.select("page_id", "url", F.split("html", LINK, -1).alias("between"), F.regexp_extract_all("html", F.lit(LINK), F.lit(0)).alias("tags"))
    each = parts.select("page_id", "url", F.posexplode("tags").alias("pos", "tag"))
    href = F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1)
    links = each.withColumn("href", href).withColumn("link", urls.resolve(F.col("href"), F.col("url"))).withColumn("norm", urls.normalize(F.col("link")))
    kept = (F.col("href") == "") | F.col("href").startswith("#") | ~F.col("link").rlike("(?i)^https?:")
    to = link_target(F.col("link"), F.col("type"), F.col("target"), F.col("asset_path"))
    new = F.concat(F.regexp_extract("tag", r'(?i)^(.*?)href="', 1), F.lit('href="'), to, F.lit('" data-archive-original-href="'), text.escaped(F.col("link")), F.lit('"'), F.regexp_extract("tag", r'(?i)href="[^"]*"(.*)$', 1))
    routed = links.join(routes, "norm", "left").withColumn("tag", F.when(kept, F.col("tag")).otherwise(new))
    listed = routed.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("new"))
    joined = F.zip_with("between", F.coalesce("new", F.array().cast("array<struct<pos:int,tag:string>>")), lambda b, t: F.concat(b, F.coalesce(t["tag"], F.lit(""))))
    return parts.join(listed, "page_id", "left").select("page_id", F.array_join(joined, "").alias("html"))


def checked_manifests(rows: DataFrame) -> DataFrame:
    """rows (id, manifest) with code: ok, or the first reason to refuse a manifest (JSON text)."""
    m = F.from_json("manifest", MANIFEST)
    is_list = lambda c: F.coalesce(F.substring(F.get_json_object("manifest", f"$.{c}"), 1, 1) == "[", F.lit(False))
    missing = m["formatVersion"].isNull() | (F.coalesce(m["archiveId"], F.lit("")) == "") | ~(is_list("pages") & is_list("assets") & is_list("routes") & is_list("responses") & is_list("failures"))
    odd_page = F.exists(m["pages"], lambda p: p["pageId"].isNull() | p["htmlPath"].isNull() | p["htmlSha256"].isNull())
    odd_asset = F.exists(m["assets"], lambda a: a["sha256"].isNull() | a["path"].isNull())
    unsafe = F.exists(referenced(m), lambda p: ~is_safe_path(p))
    code = (
        F.when(F.get_json_object("manifest", "$").isNull() | missing | odd_page | odd_asset, "malformed-manifest")
        .when(m["formatVersion"] > FORMAT_VERSION, "unsupported-version")
        .when(unsafe, "unsafe-path")
        .otherwise("ok")
    )
    return rows.withColumn("code", code)


def referenced(manifest: Column) -> Column:
    """All paths that a manifest names."""
    pages = F.flatten(F.transform(manifest["pages"], lambda p: F.array(p["htmlPath"], p["textPath"])))
    every = F.concat(pages, F.transform(manifest["assets"], lambda a: a["path"]), F.array(manifest["indexPath"]))
    return F.filter(every, lambda p: p.isNotNull() & (p != ""))


def is_safe_path(path: Column) -> Column:
    """Relative, without a drive, a backslash, a null character or a step upwards."""
    return ~path.rlike(r"^/|^[A-Za-z]:|\\|\x00|(^|/)\.\.(/|$)")


def owned_entries(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """entries (id, path) that their manifest names."""
    named = manifests.select("id", F.explode(referenced(F.from_json("manifest", MANIFEST))).alias("path")).distinct()
    return entries.join(named, ["id", "path"], "left_semi")


def served(requests: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """requests (path) with found (page, text, asset, unavailable or missing) and content_type; pages: page_id, has_text, assets: sha256, path."""
    kind, key = F.substring_index("path", "/", 1), F.regexp_extract("path", r"^[^/]*/([^/?]*)", 1)
    sha = F.substring_index(key, ".", 1)
    by_page = pages.select(F.col("page_id").cast("string").alias("_page"), "has_text")
    by_sha = assets.select(F.col("sha256").alias("_sha"), F.col("path").alias("_path")).distinct()
    both = requests.withColumn("_kind", kind).withColumn("_key", key).join(by_page, F.col("_key") == F.col("_page"), "left").join(by_sha, sha == F.col("_sha"), "left")
    known, safe = F.col("_page").isNotNull(), is_safe_path(F.col("path"))
    found = (
        F.when(~safe, "missing")
        .when(F.col("path").startswith("__unavailable__"), "unavailable")
        .when((F.col("_kind") == "page") & known, "page")
        .when((F.col("_kind") == "text") & known & F.col("has_text"), "text")
        .when((F.col("_kind") == "assets") & F.col("_sha").isNotNull(), "asset")
        .otherwise("missing")
    )
    out = both.withColumn("found", found)
    mime = F.when(F.col("found").isin("page", "unavailable"), CONTENT_TYPES["html"]).when(F.col("found") == "asset", content_type(F.col("_path"))).otherwise(CONTENT_TYPES["txt"])
    return out.select(*requests.columns, "found", mime.alias("content_type"))


def content_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(known[F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))], F.lit("application/octet-stream"))


def asset_sources(blobs: DataFrame) -> DataFrame:
    """(sha256, first_url, sources): per content the first writer's URL and all URLs, each once, in order of their first write (blobs: seq, url, content)."""
    once = blobs.select(F.sha2("content", 256).alias("sha256"), "url", "seq").groupBy("sha256", "url").agg(F.min("seq").alias("seq"))
    listed = once.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("l"))
    return listed.select("sha256", F.get("l", F.lit(0))["url"].alias("first_url"), F.transform("l", lambda s: s["url"]).alias("sources"))


def first_responses(blobs: DataFrame) -> DataFrame:
    """(sha256, url, n_bytes): the first response of each content; later URLs are dropped."""
    return blobs.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min_by("url", "seq").alias("url"), F.min(F.octet_length("content")).cast("long").alias("n_bytes"))


def byte_totals(parts: DataFrame) -> DataFrame:
    """(kind, n, n_bytes) of what a container holds (parts: kind, key, size), each key counted once."""
    return parts.groupBy("kind", "key").agg(F.first("size").alias("size")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("n_bytes"))


def forum_totals(pages: DataFrame, posts: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: sections, threads, posts, attached documents and profile pages (pages: norm, thread_key, section_key; assets: kind)."""
    own = pages.agg(F.count_distinct("section_key").alias("n_sections"), F.count_distinct("thread_key").alias("n_threads"), F.count_if(F.col("thread_key").isNull() & F.col("norm").rlike(PROFILE_URL)).alias("n_profiles"))
    more = posts.agg(F.count("*").alias("n_posts")).withColumn("one", F.lit(1)).join(assets.agg(F.count_if(F.col("kind") == "document").alias("n_attachments")).withColumn("one", F.lit(1)), "one")
    return own.withColumn("one", F.lit(1)).join(more, "one").drop("one")


def retried(pages: DataFrame, failures: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) after a retry: what was not attempted stays, and each outcome (url, norm, ok, kind) adds a page or a fresh failure.

    Failures are dropped by their URL as it was recorded, so one under a URL that isn't normalised stays beside its outcome.
    """
    tried = outcomes.select("norm").distinct()
    good, bad = outcomes.where("ok").select("norm"), outcomes.where("not ok").select("url", "kind")
    left = failures.join(tried.withColumnRenamed("norm", "url"), "url", "left_anti").select("url", "kind")
    return pages.join(tried, "norm", "left_anti").select("norm").unionByName(good), left.unionByName(bad)


def with_parent_keys(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Retried pages (norm, discovered_on) with the section and thread keys of the page that led to them."""
    parents = known.groupBy(F.col("norm").alias("discovered_on")).agg(F.min("section_key").alias("section_key"), F.min("thread_key").alias("thread_key"))
    return pages.join(parents, "discovered_on", "left")


def favicon(html: Column, page_url: Column) -> Column:
    """The first icon link of a page, else the one at its origin's root."""
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel="(?:[^"]*\s)?icon(?:\s[^"]*)?"[^>]*>""", 0)
    href = F.regexp_extract(tag, r'(?is)\bhref="([^"]*)"', 1)
    return F.when(href != "", urls.resolve(href, page_url)).otherwise(F.concat(urls.origin(page_url), F.lit("/favicon.ico")))
