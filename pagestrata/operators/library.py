"""State changes, transfer, history, eligibility, settings and limits of the library."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import urls
from pagestrata.functions.shapes import utf16_length
from pagestrata.operators import catalog

# Statuses that an import accepts, identifiers, and limits of a capture's scope.
STATUSES = catalog.STATUSES
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MAX_DEPTH, MAX_PAGES, MAX_BYTES, MAX_CONCURRENCY, MAX_DELAY_MS, MAX_LISTED = 25, 50_000, 64 * 1024**3, 6, 10_000, 100
MAX_TITLE, MAX_TAGS, MAX_TAG = 500, 32, 64
SOFT_DEPTH, SOFT_PAGES, SOFT_BYTES = 5, 200, 512 * 1024**2
CAPTURE_WIDTH, CAPTURE_HEIGHT, TEXTURE, DEVICE_PIXELS = 2_400, 12_000, 16_000, 32_000_000


def domain_excluded(domain: Column, excluded: Sequence[str]) -> Column:
    """Whether a domain is one of excluded or under one; case and blanks around entries don't count, blank entries exclude nothing."""
    names = [e.strip().lower() for e in excluded if e.strip()]
    return reduce(lambda a, b: a | b, [(domain == e) | domain.endswith("." + e) for e in names], F.lit(False))


def with_excluded(listed: Column, domain: Column) -> Column:
    """A list of excluded domains with one more, if it is not there."""
    return F.array_union(listed, F.array(F.lower(F.trim(domain))))


def capture_status(url: Column, private: Column, paused: Column, automatic: Column, excluded: Column) -> Column:
    """The first reason that speaks against a capture; null where it goes on."""
    return (
        F.when(private, "skipped-private")
        .when(~urls.is_http(url), "skipped-non-http")
        .when(paused, "skipped-excluded")
        .when(~automatic, "skipped-excluded")
        .when(excluded, "skipped-excluded")
    )


def is_archive_id(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def migrated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older schema under those of a newer one; columns that came later are null in them."""
    return new.unionByName(old, allowMissingColumns=True)


def changed(archives: DataFrame, changes: DataFrame) -> DataFrame:
    """archives after changes (seq, id, op, value): the last of each op per id; ops are title, tags, size, status, body and delete."""
    last = changes.groupBy("id").pivot("op", ["title", "tags", "size", "status", "body", "delete"]).agg(F.max_by("value", "seq"))
    both = archives.join(last.select("id", *[F.col(c).alias(f"_{c}") for c in last.columns if c != "id"]), "id", "left")
    to = {
        "title": F.coalesce("_title", "title"),
        "tags": F.coalesce("_tags", "tags"),
        "size_bytes": F.coalesce(F.col("_size").cast("long"), F.col("size_bytes")),
        "status": F.coalesce("_status", "status"),
        "body": F.coalesce("_body", "body"),
        "deleted": F.col("deleted") | F.col("_delete").isNotNull(),
    }
    return both.select(*[to[c].alias(c) if c in to else c for c in archives.columns])


def change_fault(title: Column, tags: Column) -> Column:
    """The first limit that a change of title and tags breaks; null where it is valid. Nulls change nothing and are valid."""
    return (
        F.when(utf16_length(title) > MAX_TITLE, "title-too-long")
        .when(F.size(tags) > MAX_TAGS, "too-many-tags")
        .when(F.exists(tags, lambda t: utf16_length(t) > MAX_TAG), "tag-too-long")
    )


def indexed(archives: DataFrame) -> DataFrame:
    """What full-text search indexes: active rows only, with the body if it is known."""
    return archives.where(~F.col("deleted")).select("id", "title", "final_url", "domain", F.coalesce("body", F.lit("")).alias("body"))


def deleted_by_domain(archives: DataFrame, domains: DataFrame) -> DataFrame:
    """archives with all active rows of the given domains marked as deleted."""
    gone = domains.select("domain").distinct().withColumn("_gone", F.lit(True))
    both = archives.join(gone, "domain", "left")
    return both.select(*[(F.col("deleted") | F.coalesce("_gone", F.lit(False))).alias(c) if c == "deleted" else c for c in archives.columns])


def exported(archives: DataFrame, files: DataFrame) -> DataFrame:
    """Active rows, oldest first, with flags that hold only where the row claims a file (id, name) that is there; the favicon's path is left out."""
    there = files.groupBy("id").agg(*[F.max(F.col("name") == n).alias(f"_{c}") for c, n in (("text", "text.txt"), ("favicon", "favicon.png"))])
    both = archives.where(~F.col("deleted")).join(there, "id", "left")
    flag = lambda claim, have: (claim & F.coalesce(F.col(have), F.lit(False)))
    return both.select(
        "id", "visited_at", flag(F.col("has_text"), "_text").alias("has_text"), flag(F.col("favicon_path").isNotNull(), "_favicon").alias("has_favicon"), F.lit(None).cast("string").alias("favicon_path")
    ).orderBy("visited_at", "id")


def import_outcomes(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, outcome, has_text, size_bytes, n_warnings) of untrusted entries (id, canonical_url, title, status, size, tags, has_text, text_sha256, content, n_warnings).

    An entry of a wrong shape fails; an id that is there, deleted or not, is skipped;
    text whose bytes are missing or don't match is dropped with a warning, and the
    size is that of what was kept.
    """
    shaped = is_archive_id(F.col("id")) & F.col("canonical_url").isNotNull() & F.col("title").isNotNull() & F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)) & F.col("size").isNotNull() & F.col("tags").isNotNull()
    there = existing.select("id").distinct().withColumn("_known", F.lit(True))
    whole = F.col("content").isNotNull() & (F.col("text_sha256").isNull() | (F.sha2("content", 256) == F.col("text_sha256")))
    both = entries.join(there, "id", "left").withColumn("_ok", F.col("has_text") & F.coalesce(whole, F.lit(False)))
    outcome = F.when(~shaped, "failed").when(F.col("_known"), "skipped").otherwise("imported")
    got = both.withColumn("outcome", outcome)
    taken = F.col("outcome") == "imported"
    return got.select(
        "id",
        "outcome",
        (taken & F.col("_ok")).alias("has_text"),
        F.when(taken & F.col("_ok"), F.octet_length("content")).otherwise(0).cast("long").alias("size_bytes"),
        F.when(taken, F.col("n_warnings") + (F.col("has_text") & ~F.col("_ok")).cast("int")).otherwise(0).cast("long").alias("n_warnings"),
    )


def history(captures: DataFrame, failures: DataFrame, files: DataFrame) -> DataFrame:
    """captures (archive_id, captured_at, ...) newest first, with whether their file is there now, and the first message of a limit that stopped them."""
    stopped = failures.where("kind = 'stopped-at-limit'").groupBy("archive_id").agg(F.min_by("message", "seq").alias("incomplete_reason"))
    there = files.select("archive_id").distinct().withColumn("_there", F.lit(True))
    both = captures.join(stopped, "archive_id", "left").join(there, "archive_id", "left")
    return both.withColumn("file_exists", F.coalesce("_there", F.lit(False))).withColumn("complete", F.col("incomplete_reason").isNull()).drop("_there").orderBy(F.desc("captured_at"), "archive_id")


def backfilled(known: DataFrame, found: DataFrame) -> DataFrame:
    """known with the rows of found whose archive_id it lacks."""
    return known.unionByName(found.join(known.select("archive_id"), "archive_id", "left_anti"))


def policies(items: DataFrame, now: Column, retention_days: int | None, quota: float | None) -> DataFrame:
    """(id, why): items that retention removes, then those that the quota evicts among the rest; null turns a policy off.

    visited_at is compared as text; the cutoff is now less the days, in milliseconds, in the same form.
    """
    late = items.limit(0)
    if retention_days is not None:
        cutoff = F.date_format(F.timestamp_micros(F.unix_micros(now) - retention_days * 86_400_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        late = catalog.beyond_retention(items, cutoff)
    out = late.select("id", F.lit("retention").alias("why"))
    if quota is not None:
        out = out.unionByName(catalog.beyond_quota(items.join(late.select("id"), "id", "left_anti"), quota).select("id", F.lit("quota").alias("why")))
    return out


def clamped(value: Column, low: int, high: int) -> Column:
    """A limit held within low and high; null, which is unlimited, stays."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def clamped_scope(scopes: DataFrame) -> DataFrame:
    """scopes (max_depth, max_pages, max_bytes, concurrency, delay_ms, domains) held within the hard limits."""
    return scopes.withColumns(
        {
            "max_depth": clamped(F.col("max_depth"), 0, MAX_DEPTH),
            "max_pages": clamped(F.col("max_pages"), 1, MAX_PAGES),
            "max_bytes": clamped(F.col("max_bytes"), 1024**2, MAX_BYTES),
            "concurrency": F.greatest(F.lit(1), F.least("concurrency", F.lit(MAX_CONCURRENCY))),
            "delay_ms": F.greatest(F.lit(0), F.least("delay_ms", F.lit(MAX_DELAY_MS))),
            "domains": F.slice("domains", 1, MAX_LISTED),
        }
    )


def beyond_soft_limits(depth: Column, pages: Column, size: Column) -> Column:
    return depth.isNull() | pages.isNull() | size.isNull() | (depth > SOFT_DEPTH) | (pages > SOFT_PAGES) | (size > SOFT_BYTES)


def described_limit(value: Column, unit: str) -> Column:
    return F.concat(F.coalesce(value.cast("string"), F.lit("unlimited")), F.lit(f" {unit}"))


def duration(ms: Column) -> Column:
    """Milliseconds as 5s or 3m 05s."""
    seconds = F.floor(ms / 1000)
    minutes = F.floor(seconds / 60)
    rest = (seconds % 60).cast("string")
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), F.lpad(rest, 2, "0"), F.lit("s"))).otherwise(F.concat(rest, F.lit("s")))


def fitted(css_width: Column, css_height: Column, device_scale: Column) -> Column:
    """struct<width, height, scale, device_width, device_height> of a capture within the limits of textures and pixels."""
    dsf = F.greatest(F.lit(1.0), device_scale)
    width, height = (F.greatest(F.lit(1), F.least(F.ceil(c), F.lit(most))) for c, most in ((css_width, CAPTURE_WIDTH), (css_height, CAPTURE_HEIGHT)))
    exact = F.least(F.lit(1.0), TEXTURE / (height * dsf), TEXTURE / (width * dsf), F.sqrt(DEVICE_PIXELS / (width * height * dsf * dsf)))
    scale = F.greatest(F.lit(0.01), F.floor(exact * 1000) / 1000)
    pixels = lambda n: F.floor(n * scale * dsf + 0.5)
    return F.struct(width.alias("width"), height.alias("height"), scale.alias("scale"), pixels(width).alias("device_width"), pixels(height).alias("device_height"))


SETTINGS = "struct<autoCaptureEnabled:boolean,captureDelayMs:long,retentionDays:long,excludedDomains:array<string>,permissionDefaults:map<string,string>>"


def merged_settings(raw: Column, defaults: dict[str, object], permissions: dict[str, str]) -> Column:
    """User settings (JSON text) over defaults, permissions merged one by one; text that is no object gives the defaults."""
    got = F.from_json(raw, SETTINGS)
    own = [F.coalesce(got[k], F.lit(v)).alias(k) for k, v in defaults.items()]
    base = F.create_map(*[F.lit(x) for kv in permissions.items() for x in kv])
    given = F.coalesce(got["permissionDefaults"], F.create_map().cast("map<string,string>"))
    each = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k)), given)
    return F.struct(*own, each.alias("permissionDefaults"))
