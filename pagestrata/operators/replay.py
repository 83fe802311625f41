"""Replay of a capture journal (archive_id, seq, t, norm, ...) into the state of its container.

Every fold is a grouping or a join by key, so captures of any length are spread over
tasks; only lists of one asset's sources are arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.operators import journal

VERSION = 1


def added_sources(records: DataFrame) -> DataFrame:
    """(archive_id, sha, url, seq): URLs added to an asset after its last record, by their first addition."""
    last = records.where("t = 'asset'").groupBy("archive_id", "sha").agg(F.max_by(F.struct("seq", "url"), "seq").alias("a")).select("archive_id", "sha", F.col("a.seq").alias("_at"), F.col("a.url").alias("_own"))
    more = records.where("t = 'assetUrl'").select("archive_id", "sha", "url", "seq").join(last, ["archive_id", "sha"])
    return more.where("seq > _at and url <> _own").groupBy("archive_id", "sha", "url").agg(F.min("seq").alias("seq"))


def responses(records: DataFrame) -> DataFrame:
    """(archive_id, sha, seq, url): the last record of each response."""
    return records.where("t = 'response'").groupBy("archive_id", "sha").agg(F.max_by(F.struct("seq", "url"), "seq").alias("r")).select("archive_id", "sha", "r.*")


def entries(records: DataFrame) -> DataFrame:
    """(archive_id, what, key, seq, value): all that a replay knows of captures, an entry a row.

    Pages, failures and posts are appended as they come, by seq; assets, responses and routes hold their last record; sources were
    added to an asset after it; queue: queued and never taken; interrupted: taken and never resolved; discovered: how often
    URLs were queued; stat and title: the last ones, an empty title doesn't count.
    """
    text = ("norm", "sha", "url", "title", "target", "post_id", "kind")
    known = records.selectExpr("archive_id", "seq", "t", *[f"coalesce({c}, '') AS {c}" for c in text], "total")

    def entry(rows: DataFrame, what: str, key, value=None) -> DataFrame:
        return rows.select("archive_id", F.lit(what).alias("what"), key.cast("string").alias("key"), "seq", (F.lit(None) if value is None else value).cast("string").alias("value"))

    of = lambda t: known.where(F.col("t") == t)
    queued = of("enq").groupBy("archive_id", "norm").agg(F.min("seq").alias("seq"))
    last = assets(known).select("archive_id", "sha", "seq", F.concat_ws("|", "kind", F.get("sources", F.lit(0))).alias("value"))
    routed = of("route").groupBy("archive_id", "norm").agg(F.max_by(F.struct("seq", "target"), "seq").alias("r")).select("archive_id", "norm", "r.*")
    counted = of("enq").groupBy("archive_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n"))
    newest = lambda rows, c: rows.groupBy("archive_id").agg(F.max_by(F.struct("seq", c), "seq").alias("r")).select("archive_id", "r.*")
    parts = [
        entry(of("page"), "page", F.col("seq"), F.col("norm")),
        entry(of("failure"), "failure", F.col("seq"), F.concat_ws("|", "kind", "norm")),
        entry(of("forumPost"), "post", F.col("seq"), F.col("post_id")),
        entry(last, "asset", F.col("sha"), F.col("value")),
        entry(added_sources(known), "source", F.concat_ws(" ", "sha", "url"), F.col("url")),
        entry(routed, "route", F.col("norm"), F.col("target")),
        entry(responses(known), "response", F.col("sha"), F.col("url")),
        entry(journal.pending(known), "queue", F.col("norm")),
        entry(journal.interrupted(known).join(queued, ["archive_id", "norm"]), "interrupted", F.col("norm")),
        entry(counted, "discovered", F.lit(""), F.col("n")),
        entry(newest(of("stat").where("total is not null"), "total"), "stat", F.lit(""), F.col("total")),
        entry(newest(of("stat").where("title <> ''"), "title"), "title", F.lit(""), F.col("title")),
    ]
    return reduce(DataFrame.unionByName, parts)


def assets(records: DataFrame) -> DataFrame:
    """(archive_id, sha, seq, kind, sources): the last record of each asset, its own URL, then those added to it later, each once.

    An asset written again loses the URLs that were added before; an added URL of an unknown asset is ignored.
    """
    last = records.where("t = 'asset'").groupBy("archive_id", "sha").agg(F.max_by(F.struct("seq", "url", "kind"), "seq").alias("a")).select("archive_id", "sha", "a.*")
    more = records.where("t = 'assetUrl'").select("archive_id", "sha", F.col("seq").alias("_at"), F.col("url").alias("_more"))
    added = more.join(last, ["archive_id", "sha"]).where("_at > seq and _more <> url").groupBy("archive_id", "sha", "_more").agg(F.min("_at").alias("_at"))
    lists = added.groupBy("archive_id", "sha").agg(F.array_sort(F.collect_list(F.struct("_at", "_more"))).alias("_l"))
    rest = F.coalesce(F.transform("_l", lambda s: s["_more"]), F.array().cast("array<string>"))
    return last.join(lists, ["archive_id", "sha"], "left").select("archive_id", "sha", "seq", "kind", F.concat(F.array("url"), rest).alias("sources"))


def routes(records: DataFrame) -> DataFrame:
    """(archive_id, norm, target): the last target of each URL."""
    return records.where("t = 'route'").groupBy("archive_id", "norm").agg(F.max_by("target", "seq").alias("target"))


def posts(records: DataFrame) -> DataFrame:
    """(archive_id, post_id, seq): the first record of each post."""
    return records.where("t = 'forumPost'").groupBy("archive_id", "post_id").agg(F.min("seq").alias("seq"))


def queue(records: DataFrame) -> DataFrame:
    """(archive_id, norm, place): what was queued and never taken, in order of queueing."""
    return journal.pending(records).select("archive_id", "norm", F.row_number().over(Window.partitionBy("archive_id").orderBy("seq")).alias("place"))


def failures(records: DataFrame) -> DataFrame:
    """(archive_id, norm, kind, seq): recorded failures, and an interrupted one (seq null) for what was taken and never resolved."""
    own = records.where("t = 'failure'").select("archive_id", "norm", "kind", "seq")
    return own.unionByName(journal.interrupted(records).select("archive_id", "norm", F.lit("interrupted").alias("kind"), F.lit(None).cast("long").alias("seq")))


def title(records: DataFrame) -> DataFrame:
    """(archive_id, title): the last title that is not empty."""
    said = (F.col("t") == "stat") & (F.coalesce("title", F.lit("")) != "")
    return records.groupBy("archive_id").agg(F.max_by(F.when(said, F.col("title")), F.when(said, F.col("seq"))).alias("title"))


def summary(records: DataFrame) -> DataFrame:
    """One row per capture: what it holds, what it left, and whether it can be finished."""
    n = lambda rows, name: rows.groupBy("archive_id").agg(F.count("*").alias(name))
    out = records.groupBy("archive_id").agg(F.count_if(F.col("t") == "page").alias("n_pages"), F.count_if(F.col("t") == "enq").alias("n_discovered"), F.max("ts").alias("last_write"))
    for rows, name in ((assets(records), "n_assets"), (routes(records), "n_routes"), (posts(records), "n_posts"), (failures(records), "n_failures"), (journal.pending(records), "n_pending")):
        out = out.join(n(rows, name), "archive_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assets", "n_routes", "n_posts", "n_failures", "n_pending")]
    return out.join(title(records), "archive_id", "left").select("archive_id", "n_pages", "n_discovered", *counts, "title", "last_write", (F.col("n_pages") > 0).alias("can_finish"))


def finished(records: DataFrame) -> DataFrame:
    """(archive_id, kind, message): the failures of captures that are finished as they are; a capture with a queue says so."""
    ready = summary(records).where("can_finish")
    left = ready.where("n_pending > 0").select(
        "archive_id", F.lit("cancelled").alias("kind"), F.concat(F.lit("Capture was interrupted before finishing; "), F.col("n_pending").cast("string"), F.lit(" discovered page(s) were never captured.")).alias("message")
    )
    own = failures(records).join(ready.select("archive_id"), "archive_id", "left_semi").select("archive_id", "kind", F.col("norm").alias("message"))
    return own.unionByName(left)


def recoverable(metas: DataFrame, records: DataFrame) -> DataFrame:
    """(archive_id, last_write, n_pages, place): captures whose sidecar (archive_id, version, start_url) is whole, newest write first."""
    whole = metas.where((F.col("version") == VERSION) & F.col("archive_id").isNotNull() & F.col("start_url").isNotNull())
    return whole.join(summary(records), "archive_id").select("archive_id", "last_write", "n_pages").orderBy(F.desc("last_write"), "archive_id")


def swept(files: DataFrame, now, stale_hours: int = 1, keep_days: int = 7) -> DataFrame:
    """(dir, n_bytes, newest, sweep) of staging folders (files: dir, size, mtime, checkpoint): idle ones go, those with a checkpoint only after keep_days."""
    dirs = files.groupBy("dir").agg(F.sum("size").alias("n_bytes"), F.max("mtime").alias("newest"), F.max("checkpoint").alias("checkpoint"))
    idle = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3_600_000_000
    return dirs.withColumn("sweep", (idle >= stale_hours) & ~((idle < 24 * keep_days) & F.col("checkpoint"))).select("dir", "n_bytes", "newest", "sweep")


def without_archive(started: DataFrame, archives: DataFrame) -> DataFrame:
    """Captures that were started and left no archive."""
    return started.select("archive_id").distinct().join(archives.select(F.col("id").alias("archive_id")), "archive_id", "left_anti")
