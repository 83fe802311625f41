"""More registered queries: replays of journals with every type of record, in batch and as a stream that is taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import replay
from pagestrata.plans.archive_queries import ASSETS, INTERRUPTED, PENDING, RECORDS, records
from pagestrata.plans.registry import register
from pagestrata.sources.tables import new_path
from pagestrata.streaming import replaying

EVERY = f"""{RECORDS.replace('records AS', 'raw AS', 1)}, records AS (SELECT * REPLACE (CASE WHEN t = 'route' AND seq % 2 = 0 THEN 'response' ELSE t END AS t), seq * 10 AS total FROM raw)"""
ENTRIES = f"""WITH {EVERY}, {ASSETS}, {INTERRUPTED}, {PENDING}
SELECT archive_id, 'page' AS what, CAST(seq AS VARCHAR) AS key, seq, norm AS value FROM records WHERE t = 'page'
UNION ALL SELECT archive_id, 'failure', CAST(seq AS VARCHAR), seq, kind || '|' || norm FROM records WHERE t = 'failure'
UNION ALL SELECT archive_id, 'post', CAST(seq AS VARCHAR), seq, post_id FROM records WHERE t = 'forumPost'
UNION ALL SELECT archive_id, 'asset', sha, seq, kind || '|' || url FROM last_asset
UNION ALL SELECT archive_id, 'source', sha || ' ' || more, pos_at, more FROM added
UNION ALL SELECT archive_id, 'route', norm, max(seq), arg_max(target, seq) FROM records WHERE t = 'route' GROUP BY ALL
UNION ALL SELECT archive_id, 'response', sha, max(seq), arg_max(url, seq) FROM records WHERE t = 'response' GROUP BY ALL
UNION ALL SELECT archive_id, 'queue', norm, seq, NULL FROM pending
UNION ALL SELECT i.archive_id, 'interrupted', i.norm, min(e.seq), NULL FROM interrupted i JOIN records e ON e.t = 'enq' AND e.archive_id = i.archive_id AND e.norm = i.norm GROUP BY ALL
UNION ALL SELECT archive_id, 'discovered', '', max(seq), CAST(count(*) AS VARCHAR) FROM records WHERE t = 'enq' GROUP BY ALL
UNION ALL SELECT archive_id, 'stat', '', max(seq), CAST(arg_max(total, seq) AS VARCHAR) FROM records WHERE t = 'stat' GROUP BY ALL
UNION ALL SELECT archive_id, 'title', '', max(seq), arg_max(title, seq) FROM records WHERE t = 'stat' AND title <> '' GROUP BY ALL"""


def every_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal records of every type, responses too."""
    t = F.when((F.col("t") == "route") & (F.col("seq") % 2 == 0), "response").otherwise(F.col("t"))
    return records(spark, sf_dir).withColumn("t", t).withColumn("total", F.col("seq") * 10).withColumn("ts", F.col("ts").cast("timestamp"))


@register(ENTRIES)
def replay_entries(spark, sf_dir):
    """ST-06, AG-12, CP-08: all entries of replayed captures."""
    return replay.entries(every_record(spark, sf_dir))


@register(ENTRIES)
def stream_replay(spark, sf_dir):
    """ST-06, ST-07: the same entries kept by a stream whose records come in any order, stopped and taken up again before its last part."""
    rows, folder, path = every_record(spark, sf_dir), new_path(spark), new_path(spark)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true")
    part = F.pmod(F.xxhash64("seq"), F.lit(3))
    for k, runs_now in enumerate((False, True, True)):
        rows.where(part == k).repartition(4, "archive_id").write.parquet(f"{folder}/part={k}")
        if runs_now:
            replaying.started(replaying.entries(source.parquet(folder), late="1000 days"), path).awaitTermination()
    return replaying.kept(spark, path)
