"""The library catalog: filters, sorts, versions, retention, quota, transfer and retry merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.operators import search
from pagestrata.operators.text_index import TextIndex
from pagestrata.sources.tables import settle

OLDEST_CONSIDERED = 10_000
MAX_PAGE, MAX_SEARCH, MAX_DOMAIN = 500, 512, 255
SORTS = ("newest", "oldest", "domain", "size")
STATUSES = ("success", "failed", "skipped-excluded", "skipped-private", "skipped-non-http")


def sort_columns(mode: str) -> list[Column]:
    by = {"newest": ["-visited_at"], "oldest": ["visited_at"], "domain": ["domain", "-visited_at"], "size": ["-size_bytes"]}
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in [*by.get(mode, by["newest"]), "id"]]


@dataclass(frozen=True)
class LibraryQuery:
    """A page of the library. Date bounds are inclusive and compared as text; limit is at most MAX_PAGE.

    A search that is blank is none. With one, rows match it, carry score and snippet, and come best first, whatever the sort.
    """

    search: str | None = None
    domain: str | None = None
    status: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    sort: str = "newest"
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        faults = {
            "search": len(self.search or "") > MAX_SEARCH,
            "domain": len(self.domain or "") > MAX_DOMAIN,
            "status": self.status is not None and self.status not in STATUSES,
            "sort": self.sort not in SORTS,
            "limit": not 1 <= self.limit <= MAX_PAGE,
            "offset": self.offset < 0,
        }
        if any(faults.values()):
            raise ValueError("out of bounds: " + ", ".join(k for k, bad in faults.items() if bad))

    @property
    def searching(self) -> bool:
        return bool((self.search or "").strip())

    def filtered(self, archives: DataFrame, index: TextIndex | None = None) -> DataFrame:
        """Matching rows; index: a kept index of the active rows, without which their texts are read."""
        out = archives.where(~F.col("deleted"))
        if self.searching:
            out = search.search(out, self.search) if index is None else out.join(index.search(self.search, search.LIBRARY_WEIGHTS), "id")
        for column, op, value in (("domain", "__eq__", self.domain), ("status", "__eq__", self.status), ("visited_at", "__ge__", self.date_from), ("visited_at", "__le__", self.date_to)):
            if value is not None:
                out = out.where(getattr(F.col(column), op)(value))
        return out

    def page(self, archives: DataFrame, index: TextIndex | None = None) -> DataFrame:
        found = self.filtered(archives, index)
        if not self.searching:
            return found.withColumn("snippet", F.lit(None).cast("string")).orderBy(*sort_columns(self.sort)).offset(self.offset).limit(self.limit)
        order = [F.round("score", 9), F.col("id")]
        if index is None:
            best = found.orderBy(*order).offset(self.offset).limit(self.limit)
        else:
            # the page is picked by scores and filters alone; texts are read for its rows only, at most MAX_PAGE
            picked = settle(found.select("id", "score").orderBy(*order).offset(self.offset).limit(self.limit))
            best = archives.join(F.broadcast(picked.select("id")), "id", "left_semi").repartition("id").join(F.broadcast(picked), "id")
        shown = best.withColumn("snippet", search.best_snippet([F.col(c) for c in search.LIBRARY_WEIGHTS], search.query_words(self.search)))
        return shown if index is None else shown.orderBy(*order)


def versions(archives: DataFrame) -> DataFrame:
    """Active rows with the count of versions of their page and their place, newest first."""
    by = Window.partitionBy("canonical_url")
    return archives.where(~F.col("deleted")).select(
        "id", "canonical_url", F.count("*").over(by).alias("n_versions"), F.row_number().over(by.orderBy(F.desc("visited_at"), "id")).alias("place")
    )


def latest_success(archives: DataFrame) -> DataFrame:
    good = archives.where(~F.col("deleted") & (F.col("status") == "success"))
    return good.groupBy("canonical_url").agg(F.max_by("id", F.struct("visited_at", "id")).alias("id"), F.max("visited_at").alias("visited_at"))


def usage(archives: DataFrame) -> DataFrame:
    active = archives.where(~F.col("deleted"))
    return active.agg(F.count("*").alias("n_archives"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def beyond_retention(items: DataFrame, cutoff: Column) -> DataFrame:
    """Items older than the cutoff, among the oldest OLDEST_CONSIDERED."""
    return items.orderBy("visited_at", "id").limit(OLDEST_CONSIDERED).where(F.col("visited_at") < cutoff)


def beyond_quota(items: DataFrame, quota: float) -> DataFrame:
    """Oldest items to evict until what remains fits the quota; the running sum covers the oldest OLDEST_CONSIDERED only."""
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    oldest = items.orderBy("visited_at", "id").limit(OLDEST_CONSIDERED)
    before = Window.orderBy("visited_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    freed = oldest.withColumn("freed", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return freed.join(F.broadcast(total)).where(F.col("total") - F.col("freed") > quota).select("id", "visited_at", "size")


def import_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of incoming whose id is not there yet, deleted rows counting as there, with their outcome."""
    there = existing.select("id").distinct().withColumn("known", F.lit(True))
    hash_ok = F.col("expected_sha256").isNull() | (F.col("expected_sha256") == F.sha2("content", 256))
    outcome = F.when(F.col("known"), "skipped").when(~hash_ok, "failed").otherwise("imported")
    return incoming.join(there, "id", "left").select("id", F.coalesce(outcome, F.lit("imported")).alias("outcome"))


def upsert_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order."""
    last = F.max_by(F.struct(*rows.columns), order)
    return rows.groupBy(key).agg(last.alias("r")).select("r.*")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
