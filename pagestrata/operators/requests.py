"""Untrusted input of the library: entries of an imported manifest and requests, checked field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.shapes import Field, faults
from pagestrata.operators import library

# Fields of formats, their kinds, limits and choices.
TEXT, BOOLEAN = Field("text"), Field("boolean")
ENTRY = {
    "id": TEXT, "canonicalUrl": TEXT, "originalUrl": TEXT, "finalUrl": TEXT, "title": TEXT, "domain": TEXT, "referrerUrl": Field("text", null=True), "capturedAt": TEXT, "visitedAt": TEXT,
    "status": Field("text", choices=tuple(library.STATUSES)), "warnings": Field("list"), "sizeBytes": Field("number"), "appVersion": TEXT, "schemaVersion": Field("number"), "tags": Field("texts"),
    "hasMhtml": BOOLEAN, "hasScreenshot": BOOLEAN, "hasText": BOOLEAN, "hasFavicon": BOOLEAN,
    "mhtmlSha256": Field("text", null=True), "screenshotSha256": Field("text", null=True), "textSha256": Field("text", null=True),
}
ID = Field("text", pattern=library.UUID)
LONG_TEXT = Field("text", low=1, high=4096)
DOMAINS = Field("texts", most=100, longest=255)
MAYBE = Field("boolean", absent=True)
CAPTURE_SCOPE = {
    "kind": Field("text", choices=("current-page", "entire-site", "custom", "forum-thread", "forum-section", "forum-whole")),
    "maxDepth": Field("whole", null=True, low=0, high=library.MAX_DEPTH), "maxPages": Field("whole", null=True, low=1, high=library.MAX_PAGES), "maxTotalBytes": Field("whole", null=True, low=1024**2, high=library.MAX_BYTES),
    "allowedDomains": DOMAINS, "includeExternalDomains": DOMAINS, "includeDocuments": BOOLEAN, "includeMedia": BOOLEAN,
    "crawlDelayMs": Field("whole", low=0, high=library.MAX_DELAY_MS), "concurrency": Field("whole", low=1, high=library.MAX_CONCURRENCY),
    "allowedNonContentPaths": Field("texts", absent=True, most=100, longest=255), "forumIncludeProfiles": MAYBE, "forumDownloadAttachments": MAYBE, "forumAttemptExternalImages": MAYBE,
}
SETTINGS = {
    "autoCaptureEnabled": MAYBE, "captureDelayMs": Field("whole", absent=True, low=0, high=60_000), "maxDiskUsageMb": Field("whole", absent=True, null=True, low=0), "retentionDays": Field("whole", absent=True, null=True, low=0),
    "excludedDomains": Field("texts", absent=True, most=2000, longest=255), "searchEngineUrlTemplate": Field("text", absent=True, high=2048), "screenshotQuality": Field("whole", absent=True, low=1, high=100),
    "diagnosticLogging": MAYBE, "permissionDefaults": Field("choices", absent=True, choices=("ask", "deny", "allow")),
}
LIBRARY_QUERY = {
    "search": Field("text", absent=True, high=512), "domain": Field("text", absent=True, high=255), "status": Field("text", absent=True, choices=tuple(library.STATUSES)), "dateFrom": Field("text", absent=True), "dateTo": Field("text", absent=True),
    "sort": Field("text", absent=True, choices=("newest", "oldest", "domain", "size")), "limit": Field("whole", absent=True, low=1, high=500), "offset": Field("whole", absent=True, low=0),
}
REQUESTS = {
    "capture-scope": CAPTURE_SCOPE, "settings": SETTINGS, "library-query": LIBRARY_QUERY,
    "rename": {"archiveId": ID, "title": Field("text", high=library.MAX_TITLE)}, "tag": {"archiveId": ID, "tags": Field("texts", most=library.MAX_TAGS, longest=library.MAX_TAG)},
    "by-archive": {"archiveId": ID}, "by-domain": {"domain": LONG_TEXT}, "by-url": {"url": LONG_TEXT}, "archive-search": {"tabId": ID, "query": Field("text", high=500)},
}


def request_faults(kind: str, body: Column) -> Column:
    """The fields of a request (JSON text) of a kind that break its rules; an empty list is a valid request."""
    return faults(body, REQUESTS[kind])


def manifest_entries(lines: DataFrame, body: str = "entry") -> DataFrame:
    """lines with faults and the fields of each entry that an import takes up; fields of entries with faults are null.

    The result joined with contents is what library.import_outcomes takes: null fields fail there.
    """
    checked = lines.withColumn("faults", faults(F.col(body), ENTRY))
    held = F.from_json(F.when(F.size("faults") == 0, F.col(body)), "id string, canonicalUrl string, title string, status string, sizeBytes double, tags array<string>, hasText boolean, textSha256 string, warnings array<string>")
    got = checked.withColumn("_e", held)
    names = {"id": "id", "canonical_url": "canonicalUrl", "title": "title", "status": "status", "size": "sizeBytes", "tags": "tags", "has_text": "hasText", "text_sha256": "textSha256"}
    fields = {k: F.col(f"_e.{v}") for k, v in names.items()} | {"n_warnings": F.size("_e.warnings")}
    return got.withColumns({k: F.when(F.size("faults") == 0, v) for k, v in fields.items()}).drop("_e")
