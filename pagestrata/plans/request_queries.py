"""More registered queries: entries of imports and requests, each field of which takes each kind of value over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import library, requests
from pagestrata.plans.registry import register
from pagestrata.sources import views

#: JSON texts that take a field's place; the last one leaves the field out.
VALUES = {"null": "null", "text": '"x"', "number": "7.5", "boolean": "true", "list": "[1]", "texts": '["a"]', "object": '{"a": 1}', "absent": None}
#: For each field the values of VALUES that it may have.
ENTRY_ALLOWS = {
    "id": "text", "canonicalUrl": "text", "originalUrl": "text", "finalUrl": "text", "title": "text", "domain": "text", "referrerUrl": "text null", "capturedAt": "text", "visitedAt": "text", "status": "",
    "warnings": "list texts", "sizeBytes": "number", "appVersion": "text", "schemaVersion": "number", "tags": "texts", "hasMhtml": "boolean", "hasScreenshot": "boolean", "hasText": "boolean", "hasFavicon": "boolean",
    "mhtmlSha256": "text null", "screenshotSha256": "text null", "textSha256": "text null",
}
SCOPE_ALLOWS = {
    "kind": "", "maxDepth": "null", "maxPages": "null", "maxTotalBytes": "null", "allowedDomains": "texts", "includeExternalDomains": "texts", "includeDocuments": "boolean", "includeMedia": "boolean", "crawlDelayMs": "", "concurrency": "",
    "allowedNonContentPaths": "texts absent", "forumIncludeProfiles": "boolean absent", "forumDownloadAttachments": "boolean absent", "forumAttemptExternalImages": "boolean absent",
}
SETTINGS_ALLOWS = {
    "autoCaptureEnabled": "boolean absent", "captureDelayMs": "absent", "maxDiskUsageMb": "null absent", "retentionDays": "null absent", "excludedDomains": "texts absent", "searchEngineUrlTemplate": "text absent",
    "screenshotQuality": "absent", "diagnosticLogging": "boolean absent", "permissionDefaults": "absent",
}


def varied(number: Column, whole: dict[str, str]) -> Column:
    """JSON objects of the given fields and values, of which one field of each row has another kind of value."""
    names, kinds = list(whole), list(VALUES.values())
    place, kind = number % len(names), F.floor(number / len(names)) % len(kinds)
    other = F.get(F.array(*[F.lit(k) for k in kinds]), kind.cast("int"))
    each = [F.concat(F.lit(f'"{n}": '), F.when(place == i, other).otherwise(F.lit(v))) for i, (n, v) in enumerate(whole.items())]
    return F.concat(F.lit("{"), F.array_join(F.array(*each), ", "), F.lit("}"))


def expected(number: str, allows: dict[str, str]) -> str:
    """SQL: the field that varied() made wrong, or an empty text."""
    rows = ", ".join(f"({i}, '{n}', '{a}')" for i, (n, a) in enumerate(allows.items()))
    kind = f"['{"', '".join(VALUES)}'][CAST(floor({number} / {len(allows)}) % {len(VALUES)} AS BIGINT) + 1]"
    return f"(SELECT CASE WHEN list_contains(string_split(f.allows, ' '), {kind}) THEN '' ELSE f.name END FROM (VALUES {rows}) f(i, name, allows) WHERE f.i = {number} % {len(allows)})"


GOOD = {
    "text": '"t"', "text null": '"t"', "list texts": "[1, null]", "number": "3", "texts": "[]", "boolean": "false",
}
ENTRY_GOOD = {n: GOOD.get(a, '"success"') for n, a in ENTRY_ALLOWS.items()} | {"sizeBytes": "1e3"}
SCOPE_GOOD = {n: {"kind": '"custom"', "maxDepth": "25", "maxPages": "50000.0", "maxTotalBytes": "1048576", "crawlDelayMs": "0", "concurrency": "6"}.get(n, "[]" if "texts" in a else "true") for n, a in SCOPE_ALLOWS.items()}
SETTINGS_GOOD = {n: {"captureDelayMs": "60000", "maxDiskUsageMb": "0", "retentionDays": "30", "excludedDomains": '["x.example"]', "searchEngineUrlTemplate": '"https://s.example/?q=%s"', "screenshotQuality": "100", "permissionDefaults": '{"camera": "ask"}'}.get(n, "true") for n in SETTINGS_ALLOWS}


@register(f"SELECT doc_id, {expected('doc_id', ENTRY_ALLOWS)} AS faults FROM documents")
def import_entry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-36, SRC-21: entries of a manifest, each of whose 22 fields takes each kind of value."""
    rows = views.table(spark, sf_dir, "documents").select("doc_id", varied(F.col("doc_id"), ENTRY_GOOD).alias("entry"))
    return requests.manifest_entries(rows).select("doc_id", F.array_join("faults", ",").alias("faults"))


@register(f"SELECT doc_id, {expected('doc_id', SCOPE_ALLOWS)} AS scope, {expected('doc_id', SETTINGS_ALLOWS)} AS settings FROM documents")
def request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-35: requests for captures and settings, each of whose fields takes each kind of value."""
    rows = views.table(spark, sf_dir, "documents")
    found = {"scope": ("capture-scope", SCOPE_GOOD), "settings": ("settings", SETTINGS_GOOD)}
    return rows.select("doc_id", *[F.array_join(requests.request_faults(kind, varied(F.col("doc_id"), good)), ",").alias(name) for name, (kind, good) in found.items()])


@register("""WITH e AS (SELECT doc_id, text, doc_id % 9 = 4 AS broken, doc_id % 5 = 2 AS known FROM documents)
SELECT doc_id, CASE WHEN broken THEN 'failed' WHEN known THEN 'skipped' ELSE 'imported' END AS outcome, NOT broken AND NOT known AND text IS NOT NULL AND doc_id % 7 <> 3 AS has_text FROM e""")
def import_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21, PF-36, DM-11: a manifest's entries as JSON, checked in every field, met with their texts and with what the library has."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    i = F.col("doc_id")
    ident = F.regexp_replace(F.md5(i.cast("string").cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    sha = F.when(i % 7 == 3, "bad").otherwise(F.coalesce(F.sha2("content", 256), F.lit("none")))
    good = ENTRY_GOOD | {"hasText": "true"}
    fixed = F.concat_ws(", ", *[F.lit(f'"{n}": {v}') for n, v in good.items() if n not in ("id", "textSha256", "title")])
    title = F.when(i % 9 == 4, "5").otherwise('"t"')
    entry = F.concat(F.lit('{"id": "'), ident, F.lit('", "textSha256": "'), sha, F.lit('", "title": '), title, F.lit(", "), fixed, F.lit("}"))
    entries = requests.manifest_entries(docs.select("doc_id", "content", entry.alias("entry"), ident.alias("uid")))
    names = entries.select("doc_id", "uid")
    out = library.import_outcomes(entries.withColumn("id", F.col("uid")), names.where("doc_id % 5 = 2").select(F.col("uid").alias("id")))
    return out.join(names.withColumnRenamed("uid", "id"), "id").select("doc_id", "outcome", "has_text")
