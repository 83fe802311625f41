"""Crawl dataflow: the link ladder, the fair frontier, budgets, failures, robots and reachability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions import urls

MAX_FAILURES, MAX_SKIPS_PER_KIND, MAX_PAGINATION_HOPS, MAX_DISCOVERED = 5000, 500, 500, 50_000
# Failure kinds that a retry attempts again.
RETRYABLE = ("fetch-failed", "http-error", "timeout", "too-large", "redirect-loop", "render-process-gone", "render-failed", "serialize-failed", "disk-full", "interrupted")


def ladder(links: DataFrame, forum: bool = False, domains: tuple[str, ...] = ()) -> DataFrame:
    """The decision for each link (page_url, url, ...), first rule first: drop, a skip kind, or enqueue."""
    url = F.col("url")
    pages = urls.looks_pagination(url) if forum else F.lit(False)
    decision = (
        F.when(~urls.is_http(url), "drop")
        .when(urls.looks_destructive(url), "skipped-sensitive")
        .when(~urls.in_scope(url, F.col("page_url"), domains), "drop")
        .when(urls.looks_print_view(url), "skipped-duplicate")
        .when(F.lit(forum) & urls.looks_attachment(url), "skipped-attachment-excluded")
        .when(~pages & urls.looks_trap(url), "skipped-trap")
        .when(urls.looks_non_content(url), "skipped-non-content")
        .otherwise("enqueue")
    )
    return links.withColumn("decision", decision)


@dataclass(frozen=True)
class ResourceScope:
    """What a capture fetches beside pages; the external_images switch counts in forum captures alone."""

    start_url: str
    media: bool = True
    documents: bool = True
    attachments: bool = True
    external_images: bool = True
    forum: bool = False


def selected_resources(resources: DataFrame, scope: ResourceScope) -> DataFrame:
    """The resources (page_id, pos, url, kind) that a capture fetches: the first of each URL of a page, then the switches.

    As repeats go before the switches apply, a URL whose first mention is left out isn't fetched for a later one.
    """
    url, kind = F.col("url"), F.col("kind")
    first = resources.groupBy("page_id", "url").agg(F.min_by(F.struct(*resources.columns), "pos").alias("r")).select("r.*")
    kept = first.where(urls.is_http(url))
    if not scope.media:
        kept = kept.where((kind != "media") & ~urls.is_media(url))
    if not scope.documents:
        kept = kept.where(~urls.is_document(url))
    if not scope.attachments:
        kept = kept.where(kind != "attachment")
    if scope.forum and not scope.external_images:
        kept = kept.where((kind != "image") | urls.origin(url).eqNullSafe(urls.origin(F.lit(scope.start_url))))
    return kept


def first_per_url(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row per normalised URL; partial minima keep a frequent URL from being one task."""
    key = F.coalesce(urls.normalize(F.col("url")), F.col("url")).alias("_key")
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def until_full(decided: DataFrame, known: DataFrame, order: list[str], bound: int = MAX_DISCOVERED) -> DataFrame:
    """decided links (url, decision, ...) up to the one that fills the crawl; those after it are not looked at.

    Each URL that is enqueued for the first time, and is none of known (norm, one row each), fills one of bound places.
    decided is read twice; settle it first where its decisions are costly.
    """
    left = bound - known.count()
    if left <= 0:
        return decided.limit(0)
    norm = F.coalesce(urls.normalize(F.col("url")), F.col("url"))
    fresh = first_per_url(decided.where("decision = 'enqueue'"), order).withColumn("norm", norm).join(known.select("norm"), "norm", "left_anti")
    full = fresh.orderBy(*order).limit(left).agg(F.count("*").alias("_n"), F.max(F.struct(*order)).alias("_last"))
    return decided.join(F.broadcast(full)).where((F.col("_n") < left) | (F.struct(*order) <= F.col("_last"))).select(*decided.columns)


def fair_order(items: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """items with turn: buckets take turns, in order of their first item, one item a turn.

    (turn, bucket_seq) is the order of the frontier; sorting by it is left to the reader.
    """
    by = Window.partitionBy(bucket)
    return items.withColumn("turn", F.row_number().over(by.orderBy(*order))).withColumn("bucket_seq", F.min(F.struct(*order)).over(by)[order[0]])


def capped_failures(failures: DataFrame, order: str) -> DataFrame:
    """At most MAX_SKIPS_PER_KIND of each skip kind, then at most MAX_FAILURES in order."""
    is_skip = F.col("kind").startswith("skipped-")
    ranked = failures.where(is_skip).withColumn("_rn", F.row_number().over(Window.partitionBy("kind").orderBy(order)))
    kept = ranked.where(F.col("_rn") <= MAX_SKIPS_PER_KIND).drop("_rn")
    others = failures.where(~is_skip).orderBy(order).limit(MAX_FAILURES)
    return kept.unionByName(others).orderBy(order).limit(MAX_FAILURES)


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (path) with allowed: the longest rule (rule, allow) that is a prefix decides, a tie allows, no match allows.

    Rules and paths with a host each meet within their host. A path's prefixes are
    joined to rules by equality, so rules of any number are no nested loop.
    """
    by = [c for c in ("host",) if c in rules.columns]
    prefixes = F.when(F.length("path") > 0, F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring("path", F.lit(1), n)))
    each = paths.distinct().withColumn("rule", F.explode(prefixes))
    best = each.join(rules.groupBy(*by, "rule").agg(F.max("allow").alias("allow")), [*by, "rule"]).groupBy(*paths.columns).agg(F.max_by("allow", F.length("rule")).alias("_allow"))
    return paths.join(best, paths.columns, "left").select(*paths.columns, F.coalesce("_allow", F.lit(True)).alias("allowed"))


def parse_robots(lines: DataFrame) -> DataFrame:
    """(host, rule, allow) of the * groups of each host's file, given as lines (host, line_no, line)."""
    body = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.select("host", "line_no", F.lower(F.trim(F.substring_index(body, ":", 1))).alias("field"), F.trim(F.regexp_extract(body, r"^[^:]*:(.*)$", 1)).alias("value"), body.contains(":").alias("ok"))
    rows = rows.where("ok and field in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("host").orderBy("line_no")
    rows = rows.withColumn("fresh", ((F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("allow")) != "user-agent")).cast("int"))
    rows = rows.withColumn("grp", F.sum("fresh").over(order))
    star = F.max(((F.col("field") == "user-agent") & (F.col("value") == "*")).cast("int")).over(Window.partitionBy("host", "grp"))
    return rows.withColumn("star", star).where("star = 1 and field <> 'user-agent'").select("host", F.col("value").alias("rule"), (F.col("field") == "allow").alias("allow"))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, settle) -> DataFrame:
    """(url, depth): pages reached from seeds within max_depth links of edges (src, dst), by supersteps."""
    seen = settle(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for depth in range(1, max_depth + 1):
        step = last.join(edges, last["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        last = settle(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not last.head(1):
            break
        seen = seen.unionByName(last)
    return seen
