"""The content-addressed container: dedup, kinds, routes, integrity and link rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File extensions by content type.
EXTENSIONS = {
    "text/css": "css", "text/html": "html", "text/plain": "txt", "application/json": "json", "image/png": "png", "image/jpeg": "jpg",
    "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/svg+xml": "svg", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico",
    "font/woff": "woff", "font/woff2": "woff2", "font/ttf": "ttf", "font/otf": "otf", "application/font-woff": "woff", "application/font-woff2": "woff2",
    "application/javascript": "js", "text/javascript": "js", "application/pdf": "pdf", "video/mp4": "mp4", "audio/mpeg": "mp3",
}


def base_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def file_extension(content_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(known[base_type(content_type)], F.lit("bin"))


def asset_kind(content_type: Column) -> Column:
    b = base_type(content_type)
    return (
        F.when(b.startswith("image/"), "image")
        .when(b.contains("font"), "font")
        .when(b.startswith("video/") | b.startswith("audio/"), "media")
        .when(b == "text/css", "stylesheet")
        .when(b.isin("application/javascript", "text/javascript"), "script")
        .when((b == "application/pdf") | b.startswith("application/vnd."), "document")
        .otherwise("other")
    )


def dedup_assets(blobs: DataFrame) -> DataFrame:
    """One row per content (blobs: seq, url, content): the first writer's data, sizes and the number of sources."""
    hashed = blobs.select("seq", "url", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_size"))
    return hashed.groupBy("sha256").agg(
        F.min("seq").alias("first_seq"), F.first("byte_size").alias("byte_size"), F.count("*").alias("n_writes"), F.count_distinct("url").alias("n_urls")
    )


def verified(entries: DataFrame) -> DataFrame:
    """entries (content, expected) with ok; a missing hash has nothing to verify."""
    return entries.withColumn("ok", F.col("expected").isNull() | (F.sha2("content", 256) == F.col("expected")))


def last_routes(routes: DataFrame) -> DataFrame:
    """The last target written per URL (routes: seq, norm, target)."""
    return routes.groupBy("norm").agg(F.max_by("target", "seq").alias("target"))


def rewritten(links: DataFrame, routes: DataFrame) -> DataFrame:
    """links (norm, ...) with local: the archive path of their route, or the page for what is not archived."""
    fallback = F.concat(F.lit("/__unavailable__?url="), F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")))
    return links.join(routes, "norm", "left").withColumn("local", F.when(F.col("target").isNotNull(), F.concat(F.lit("/page/"), F.col("target").cast("string"))).otherwise(fallback))
