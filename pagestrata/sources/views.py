"""The entities of a web archive, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import forms, html, urls

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per captured page: identities, title, body, size, status, time and soft-delete flag.

    Pages are dealt by their ids before they are read as HTML: a file of few row groups would be few tasks.
    """
    url = F.col("url")
    return table(spark, sf_dir, "pages").repartition("page_id").select(
        F.col("page_id").alias("id"),
        url.alias("final_url"),
        urls.canonicalize(url).alias("canonical_url"),
        urls.host(url).alias("domain"),
        html.title(F.col("html")).alias("title"),
        html.text(F.col("html")).alias("body"),
        F.char_length("html").cast("long").alias("size_bytes"),
        F.when(url.startswith("https"), "success").otherwise("failed").alias("status"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600), STAMP).alias("visited_at"),
        url.contains("ref=").alias("deleted"),
    )


#: What decorated_pages() adds to each page: forms, resources and links with attributes, {id} being the page.
EXTRA = (
    '<link rel="stylesheet" href="/s/{id}.css"><img src="/i/{id}.png" srcset="/i/a.png 1x, /i/b.png 2x">'
    '<form action="/login"><input type="hidden" name="csrf" value="{id}"><input name="q" value="kept"><a href="/inform/{id}">In</a></form>'
    '<a href="/files/{id}.pdf" download>File</a><a rel="nofollow" href="/no/{id}">No</a><a href="/t/page/{id}">Next</a><a href="/members/{id}">Who</a>'
)


def decorated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with forms, resources and links that they lack."""
    extra = F.replace(F.lit(EXTRA), F.lit("{id}"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", extra).alias("html"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per anchor of decorated pages, with its attributes and the URL that it resolves to."""
    pages = decorated_pages(spark, sf_dir)
    found = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(forms.anchors(F.col("html"))).alias("pos", "a")).select("page_id", "page_url", "pos", "a.*")
    return found.withColumn("url", urls.resolve(F.col("href"), F.col("page_url")))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per thing that decorated pages load, in order, then their anchors that download or look like attachments."""
    pages = decorated_pages(spark, sf_dir)
    found = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(forms.resources(F.col("html"))).alias("pos", "r"))
    loaded = found.select("page_id", "pos", urls.resolve(F.col("r.href"), F.col("page_url")).alias("url"), F.col("r.kind").alias("kind"))
    attached = anchors(spark, sf_dir).where(F.col("download") | urls.looks_attachment(F.col("url")))
    return loaded.unionByName(attached.select("page_id", (F.col("pos") + F.lit(1 << 20)).alias("pos"), "url", F.lit("attachment").alias("kind")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per anchor: page, position, href and the URL that it resolves to."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))
    return found.withColumn("url", urls.resolve(F.col("href"), F.col("page_url")))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_key"), F.col("turn").alias("post_number"), F.col("role").alias("author"), F.col("text").alias("body"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_journal(table(spark, sf_dir, "events"))


def as_journal(events: DataFrame) -> DataFrame:
    """Events as journal records of one capture per user, in order of event_id."""
    kinds = {"view": "enq", "click": "deq", "purchase": "page", "error": "failure"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("stat"))
    return events.select(F.col("user_id").alias("archive_id"), F.col("event_id").alias("seq"), kind.alias("t"), F.get_json_object("props", "$.k").alias("norm"), "ts", "value")
