"""The full decision ladder for the links of a forum crawl."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions import urls
from pagestrata.operators.crawl import MAX_PAGINATION_HOPS


@dataclass(frozen=True)
class ForumScope:
    """What a forum crawl may take in: kind is whole, section or thread."""

    start_url: str
    kind: str = "whole"
    domains: tuple[str, ...] = ()
    max_depth: int | None = None
    attachments: bool = True
    profiles: bool = False
    allowed_paths: tuple[str, ...] = ()

    def outside(self, url: Column, page: Column, pagination: Column) -> Column:
        """Links that the narrower kinds leave out."""
        start, key, page_key = (urls.thread_key(urls.normalize(u)) for u in (F.lit(self.start_url), url, page))
        if self.kind == "thread":
            return key != start
        if self.kind == "section":
            shaped = urls.leading_segment(url) == urls.leading_segment(F.lit(self.start_url))
            from_section = (page_key == start) & (key != start) & shaped
            return ~((key == start) | from_section | (pagination & (key == page_key)))
        return F.lit(False)


def ladder(links: DataFrame, scope: ForumScope, order: list[str]) -> DataFrame:
    """links with decision (drop, a skip kind, attachment, or enqueue) and next_depth, the first rule that applies first.

    links: page_url, url, text, rel, download, in_form, depth, robots_allowed. Links to further pages of a thread keep
    the depth and have a bound per discovering thread, counted in the given order.
    """
    url, page = F.col("url"), F.col("page_url")
    rows = links.withColumn("_pagination", urls.looks_pagination(url, F.col("text")))
    pagination = F.col("_pagination")
    attachment = F.col("download") | urls.looks_attachment(url)
    early = (
        F.when(~urls.is_http(url), "drop")
        .when(urls.looks_destructive(url), "skipped-sensitive")
        .when(F.col("in_form") | F.array_contains(F.split("rel", r"\s+"), "nofollow"), "drop")
        .when(~urls.in_scope(url, F.lit(scope.start_url), scope.domains), "drop")
        .when(~F.col("robots_allowed"), "skipped-non-content")
        .when(urls.looks_print_view(url), "skipped-duplicate")
        .when(attachment & (F.lit(scope.attachments) | F.col("download")), "attachment")
        .when(attachment, "skipped-attachment-excluded")
        .when(~pagination & urls.looks_trap(url), "skipped-trap")
    )
    rows = rows.withColumn("_early", early).withColumn("_counted", pagination & F.col("_early").isNull()).withColumn("_thread", urls.thread_key(page))
    hop = F.row_number().over(Window.partitionBy("_thread", "_counted").orderBy(*order))
    rows = rows.withColumn("_hop", F.when(F.col("_counted"), hop)).withColumn("next_depth", F.col("depth") + F.when(pagination, 0).otherwise(1))
    deep = F.lit(False) if scope.max_depth is None else ~pagination & (F.col("next_depth") > scope.max_depth)
    late = (
        F.when(F.col("_hop") > MAX_PAGINATION_HOPS, "skipped-trap")
        .when(urls.looks_non_content(url, scope.profiles, scope.allowed_paths), "skipped-non-content")
        .when(scope.outside(url, page, pagination), "skipped-out-of-forum-scope")
        .when(deep, "drop")
        .otherwise("enqueue")
    )
    return rows.withColumn("decision", F.coalesce("_early", late)).drop("_pagination", "_early", "_counted", "_thread", "_hop")
