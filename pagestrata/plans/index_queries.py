"""More registered queries: a kept text index that follows changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators.text_index import TextIndex
from pagestrata.plans import sql
from pagestrata.plans.registry import ACTIVE, BOTH_WORDS, PAGE_WEIGHTS, active, register
from pagestrata.sources.tables import new_path, settle

#: What the changes leave: half of the rows come in later, some are renamed, some removed.
CHANGED = "changed AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'Thoughts on ' || id ELSE title END AS title, final_url, domain, body FROM active WHERE id % 11 <> 0)"


def changed_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    columns = ["title", "final_url", "domain", "body"]
    rows = active(spark, sf_dir).select("id", *columns)
    index = TextIndex.build(rows.where("id % 2 = 0"), new_path(spark), ["id"], columns)
    index.add(rows.where("id % 2 = 1"))
    index.add(rows.where("id % 7 = 0").withColumn("title", F.concat(F.lit("Thoughts on "), F.col("id").cast("string"))))
    index.remove(rows.where("id % 11 = 0"))
    return index


@register(f"WITH {sql.ARCHIVES}, {ACTIVE}, {CHANGED}, {sql.search('changed', BOTH_WORDS, PAGE_WEIGHTS)} SELECT id, round(score, 6) AS score FROM found")
def fts_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-09, DM-01..03: a search of an index after additions, renames and removals, which wrote deltas only."""
    return changed_index(spark, sf_dir).search(" ".join(BOTH_WORDS), PAGE_WEIGHTS).select("id", F.round("score", 6).alias("score"))


@register(rf"""WITH {sql.ARCHIVES}, {ACTIVE}, {CHANGED}, t AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(title || ' ' || final_url || ' ' || domain || ' ' || body)), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS term FROM changed),
g AS (SELECT term, id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_hits FROM g GROUP BY term""")
def fts_index_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-02, FT-09: the terms of an index whose changes are merged and whose dead data is deleted."""
    index = changed_index(spark, sf_dir)
    index.compact()
    index.vacuum()
    return settle(index.terms())
