"""Budgets of a capture, retries of its failures, and the suppression of repeated navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.operators.scans import deal, numbered, scan, undealt


def within_budget(pages: DataFrame, max_pages: int, max_bytes: float) -> DataFrame:
    """Per capture (pages: archive_id, seq, size): the pages taken before a bound is reached, their bytes, what stopped it and the queue left then.

    A bound is tested before each page, bytes first, so the last page may cross the byte bound; null: all pages fitted.
    """
    rows = deal(pages.select("archive_id", "seq", "size"), ["archive_id"], ["seq"])
    rows = scan(rows, ["seq"], before={"before": F.col("size"), "done": F.lit(1)})
    why = F.when(F.col("before") >= max_bytes, "bytes").when(F.col("done") >= max_pages, "pages")
    rows = rows.withColumn("why", why)
    return rows.groupBy("archive_id").agg(
        F.count_if(F.col("why").isNull()).alias("n_pages"),
        F.coalesce(F.sum(F.when(F.col("why").isNull(), F.col("size"))), F.lit(0)).alias("n_bytes"),
        F.min_by("why", F.when(F.col("why").isNotNull(), F.col("seq"))).alias("stopped_by"),
        F.count_if(F.col("why").isNotNull()).alias("n_left"),
    )


def numbered_on(new: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """new pages (thread_key, ...) with page_index, going on from the highest one of known pages (thread_key, page_index) of their thread."""
    highest = known.groupBy("thread_key").agg(F.max(F.when(F.col("page_index") > 0, F.col("page_index"))).alias("_highest"))
    placed = numbered(new, ["thread_key"], order, "page_index")
    return placed.join(highest, "thread_key", "left").withColumn("page_index", F.coalesce("_highest", F.lit(0)) + F.col("page_index")).drop("_highest")


def retry_depth(failures: DataFrame, pages: DataFrame) -> DataFrame:
    """failures (norm, discovered_on) with depth: one below the page (norm, depth) that led there, 0 where that is unknown."""
    parents = pages.groupBy(F.col("norm").alias("discovered_on")).agg(F.min("depth").alias("_depth"))
    return failures.join(parents, "discovered_on", "left").withColumn("depth", F.coalesce(F.col("_depth") + 1, F.lit(0))).drop("_depth")


def carried_over(rows: DataFrame, retried: DataFrame) -> DataFrame:
    """What a retry keeps: rows whose norm is not attempted again."""
    return rows.join(retried.select("norm").distinct(), "norm", "left_anti")


def without_repeats(visits: DataFrame) -> DataFrame:
    """Visits (archive_id, seq, norm) without those that stay on the page captured last in their tab."""
    rows = undealt(scan(deal(visits, ["archive_id"], ["seq"]), ["seq"], previous={"_last": F.col("norm")}))
    return rows.where(~F.col("norm").eqNullSafe(F.col("_last")) | F.col("_last").isNull()).drop("_last")
