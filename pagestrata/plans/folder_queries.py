"""More registered queries: journals, sidecars and robots files written to folders and read by the source of capture folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.functions import urls
from pagestrata.operators import crawl, replay
from pagestrata.plans import sql
from pagestrata.plans.archive_queries import COUNTS, RECORDS, records
from pagestrata.plans.registry import ROBOTS_LINES, register
from pagestrata.plans.replay_queries import ENTRIES, every_record
from pagestrata.sources import capture_folders as folders
from pagestrata.sources import views
from pagestrata.sources.tables import new_path, settle
from pagestrata.streaming import replaying

FIELDS = "seq long, ts_us long, norm string, t string, sha string, url string, title string, target string, post_id string, kind string, message string, total long"
#: Ranges of this many bytes, so that journals of the given tables are read by several tasks too.
SPLIT = str(64 << 10)


def as_lines(rows: DataFrame) -> DataFrame:
    """Records as rows of journals: times in microseconds, which JSON's own times don't keep."""
    fields = [c for c in rows.columns if c not in ("archive_id", "ts")]
    line = F.to_json(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), *fields))
    return rows.select(F.col("archive_id").cast("string").alias("archive_id"), "seq", line.alias("line"))


def from_lines(rows: DataFrame) -> DataFrame:
    whole = folders.records(rows, FIELDS).where("not malformed")
    return whole.withColumn("archive_id", F.col("archive_id").cast("long")).withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us", "offset", "malformed")


@register(f"""WITH {RECORDS} SELECT archive_id, t, count(*) AS n FROM records GROUP BY ALL UNION ALL SELECT archive_id, 'malformed', count(*) FROM records WHERE seq % 97 = 0 GROUP BY ALL""")
def journal_folders(spark, sf_dir):
    """SRC-10/12: journals by capture, some of whose lines are cut, read in ranges of bytes."""
    rows, path = as_lines(records(spark, sf_dir)), new_path(spark)
    folders.write(rows.unionByName(rows.where("seq % 97 = 0").withColumn("line", F.substring("line", 1, 20))), path, ["seq", "line"])
    found = folders.records(folders.read(spark, path, splitSize=SPLIT), FIELDS)
    kind = F.when(F.col("malformed"), "malformed").otherwise(F.col("t"))
    return found.groupBy(F.col("archive_id").cast("long").alias("archive_id"), kind.alias("t")).agg(F.count("*").alias("n"))


@register(f"WITH {COUNTS} SELECT archive_id, n_pages, epoch_us(last_write) AS last_write_us FROM summary WHERE archive_id % 6 <> 0 AND archive_id % 4 <> 1 AND archive_id % 10 NOT IN (3, 7)")
def recovery_folders(spark, sf_dir):
    """SRC-11, SL-08: captures with a usable sidecar beside their journal, newest write first.

    Sidecars of other versions, without a start, cut ones and those whose scope is no object aren't usable.
    """
    every, path = records(spark, sf_dir), new_path(spark)
    folders.write(as_lines(every), path, ["seq"])
    i = F.col("archive_id")
    scope = F.when(i % 10 == 7, F.lit('"all"')).otherwise(F.lit('{"maxPages": 10}'))
    start = F.when(i % 4 != 1, F.lit('"startUrl": "https://x.example/", ')).otherwise(F.lit(""))
    version = F.when(i % 6 == 0, "2").otherwise("1")
    meta = F.concat(F.lit('{"checkpointVersion": '), version, F.lit(', "archiveId": "'), i.cast("string"), F.lit('", "outputPath": "/out", '), start, F.lit('"scope": '), scope, F.lit("}"))
    line = F.when(i % 10 == 3, F.substring(meta, 1, 60)).otherwise(meta)
    folders.write(every.select("archive_id").distinct().select(i.cast("string").alias("archive_id"), line.alias("line")), path, file=folders.SIDECAR, whole="true")
    metas = folders.sidecars(spark, path).where("usable").select(i.cast("long").alias("archive_id"), "version", "start_url")
    journals = settle(from_lines(folders.read(spark, path, splitSize=SPLIT)))
    return replay.recoverable(metas, journals).select("archive_id", "n_pages", F.unix_micros("last_write").alias("last_write_us"))


@register(ENTRIES)
def stream_folders(spark, sf_dir):
    """SRC-10, ST-06/07: a replay that follows journals while they grow, stopped and taken up again in between."""
    rows, folder, path = every_record(spark, sf_dir), new_path(spark), new_path(spark)
    lines = as_lines(rows)
    for grown in (lines.where(F.col("seq") < F.lit(rows.agg(F.percentile_approx("seq", 0.5)).first()[0])), lines):
        folders.write(grown, folder, ["seq"])
        source = from_lines(folders.stream(spark, folder, splitSize=SPLIT))
        replaying.started(replaying.entries(source, late="1000 days"), path).awaitTermination()
    return replaying.kept(spark, path)


@register(f"""SELECT {sql.host('url')} AS host, {sql.path('url')} AS path, length({sql.host('url')}) % 2 = 1 OR {sql.path('url')} LIKE '/de/5%' OR {sql.path('url')} NOT LIKE '/de%' AS allowed FROM pages GROUP BY ALL""")
def robots_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: robots files of half of the hosts, read from a folder by host; hosts without a file allow everything."""
    paths, folder = views.table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")).distinct(), new_path(spark)
    hosts = paths.select(F.col("host").alias("archive_id")).distinct().where(F.length("archive_id") % 2 == 0)
    folders.write(hosts.select("archive_id", F.posexplode(F.array(*[F.lit(x) for x in ROBOTS_LINES])).alias("line_no", "line")), folder, ["line_no"], file="robots.txt")
    lines = folders.read(spark, folder, file="robots.txt").select(F.col("archive_id").alias("host"), F.col("offset").alias("line_no"), "line")
    return crawl.robots_allowed(paths, crawl.parse_robots(lines))
