"""More registered queries: the library as a kept table, changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import stored_library
from pagestrata.operators.stored_library import StoredLibrary
from pagestrata.plans import sql
from pagestrata.plans.archive_queries import AFTER
from pagestrata.plans.registry import ORACLE_SQL, register
from pagestrata.sources import views
from pagestrata.sources.keyed_table import KeyedTable
from pagestrata.sources.tables import new_path


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.archives(spark, sf_dir).withColumn("id", F.col("id").cast("string"))


def changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of archives; a third of the errors are deletes, the others are no change."""
    kind, event = F.col("event_type"), F.col("event_id").cast("string")
    op = F.when(kind == "view", "title").when(kind == "click", "tags").when(kind == "purchase", "size").when(kind == "error", "delete").otherwise("status")
    value = F.when(kind == "view", F.concat(F.lit("Title "), event)).when(kind == "click", F.concat(F.lit('["a","t'), event, F.lit('"]'))).when(kind == "purchase", event).when(kind == "error", "1").otherwise("failed")
    events = views.table(spark, sf_dir, "events").where((kind != "error") | (F.col("event_id") % 3 == 0))
    return events.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), op.alias("op"), value.alias("value"))


@register(f"WITH {AFTER} SELECT CAST(id AS VARCHAR) AS id, title, tags, size_bytes, status, deleted FROM after")
def stored_changes(spark, sf_dir):
    """DM-01..03, DM-06: a library filled by two inserts, the second with ids that are there, and changed by two runs of changes."""
    rows, changes = rows_of(spark, sf_dir), changes_of(spark, sf_dir)
    library = StoredLibrary.create(spark, new_path(spark))
    library.insert(rows.where("CAST(id AS BIGINT) % 3 <> 0"))
    library.insert(rows.withColumn("title", F.when(F.col("id").cast("long") % 3 == 0, F.col("title")).otherwise("skipped")))
    library.change(changes.where("seq % 5 < 3 and op = 'delete' or op <> 'delete' and seq < 4000"))
    library.change(changes.where("seq % 5 >= 3 and op = 'delete' or op <> 'delete' and seq >= 4000"))
    return library.rows().select("id", "title", "tags", "size_bytes", "status", "deleted")


@register(f"WITH {sql.ARCHIVES} SELECT CAST(id AS VARCHAR) AS id, title, CASE WHEN id % 3 <> 0 THEN sha256(body) END AS text_sha256, 2 AS schema_version FROM archives")
def schema_steps(spark, sf_dir):
    """SRC-02: a library of the first schema, taken through the steps once; rows from before have no hashes."""
    rows = rows_of(spark, sf_dir)
    library = StoredLibrary.create(spark, new_path(spark), version=1)
    library.insert(rows.where("CAST(id AS BIGINT) % 3 = 0"))
    library.migrate()
    library.insert(rows.where("CAST(id AS BIGINT) % 3 <> 0").withColumn("text_sha256", F.sha2("body", 256)))
    return library.rows().select("id", "title", "text_sha256", F.lit(library.migrate()).alias("schema_version"))


@register(ORACLE_SQL["history_upsert"])
def history_kept(spark, sf_dir):
    """DM-06/07: the last write of each key, put into a kept table in three runs."""
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value")
    table = KeyedTable.create(spark, new_path(spark), "key long, seq long, status string, value double", ["key"])
    bounds = [r[0] for r in rows.selectExpr("explode(percentile(seq, array(0.3, 0.6)))").collect()]
    for part in (F.col("seq") <= bounds[0], F.col("seq").between(bounds[0] + 1e-9, bounds[1]), F.col("seq") > bounds[1]):
        stored_library.upsert(table, rows.where(part), "seq")
    return table.read()


UID = "regexp_replace({h}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '{g}')"


@register(f"""WITH e AS (SELECT doc_id, {UID.format(h="md5(CAST(doc_id AS VARCHAR))", g=chr(92) + "1-" + chr(92) + "2-" + chr(92) + "3-" + chr(92) + "4-" + chr(92) + "5")} AS id, text, source FROM documents WHERE text IS NOT NULL),
j AS (SELECT *, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 THEN 'failed' WHEN doc_id % 4 = 3 THEN 'skipped' ELSE 'imported' END AS outcome, doc_id % 2 = 0 AND doc_id % 6 <> 4 AND doc_id % 5 <> 0 AS ok FROM e)
SELECT id, CASE outcome WHEN 'skipped' THEN 'known' ELSE 'of ' || source END AS title, outcome = 'imported' AND ok AS has_text, CAST(CASE WHEN outcome = 'imported' AND ok THEN strlen(text) ELSE 0 END AS BIGINT) AS size_bytes,
  CAST(CASE WHEN outcome = 'imported' THEN doc_id % 3 + CASE WHEN doc_id % 2 = 0 AND NOT ok THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS n_warnings, CASE WHEN outcome = 'imported' AND ok AND doc_id % 7 <> 0 THEN sha256(text) END AS text_sha256
FROM j WHERE outcome <> 'failed' OR doc_id % 4 = 3 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 23 <> 0""")
def stored_import(spark, sf_dir):
    """SRC-21, DM-11, PF-36: entries of an export, checked field by field as JSON, that come into a library with their verified files."""
    docs = views.table(spark, sf_dir, "documents").where("text is not null")
    n = F.col("doc_id")
    uid = F.regexp_replace(F.md5(n.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    sha = F.when(n % 5 == 0, "bad").when(n % 7 != 0, F.sha2("text", 256))
    plain = lambda **f: [v.alias(k) for k, v in f.items()]
    entry = F.to_json(
        F.struct(
            *plain(
                id=F.when(n % 11 == 0, F.concat(F.lit("../"), n.cast("string"))).otherwise(uid),
                canonicalUrl=F.lit("https://x.example/"),
                originalUrl=F.lit("https://x.example/"),
                finalUrl=F.lit("https://x.example/"),
                title=F.concat(F.lit("of "), "source"),
                domain=F.lit("x.example"),
                referrerUrl=F.lit(None).cast("string"),
                capturedAt=F.lit("2024-01-01T00:00:00.000Z"),
                visitedAt=F.lit("2024-01-01T00:00:00.000Z"),
                status=F.when(n % 13 == 0, "odd").otherwise("success"),
                warnings=F.array_repeat(F.struct(F.lit("w").alias("code")), (n % 3).cast("int")),
                sizeBytes=n,
                appVersion=F.lit("1"),
                schemaVersion=F.lit(2),
                tags=F.when(n % 2 == 0, F.array(F.lit("a"), F.lit("b,c"))).otherwise(F.array().cast("array<string>")),
                hasMhtml=F.lit(False),
                hasScreenshot=F.lit(False),
                hasText=n % 2 == 0,
                hasFavicon=F.lit(False),
                mhtmlSha256=F.lit(None).cast("string"),
                screenshotSha256=F.lit(None).cast("string"),
                textSha256=sha,
            )
        ),
        {"ignoreNullFields": "false"},
    )
    # fields of a wrong type, a field that is missing, and text that is no JSON
    broken = F.when(n % 17 == 0, F.replace(entry, F.lit('"hasMhtml":false'), F.lit('"hasMhtml":"false"'))).when(n % 19 == 0, F.replace(entry, F.lit('"appVersion":"1",'), F.lit(""))).when(n % 23 == 0, F.substring(entry, 1, 40)).otherwise(entry)
    library = StoredLibrary.create(spark, new_path(spark))
    failed = (n % 11 == 0) | (n % 13 == 0) | (n % 17 == 0) | (n % 19 == 0) | (n % 23 == 0)
    library.insert(docs.where((n % 4 == 3) & ~failed).select(uid.alias("id"), F.lit("known").alias("title")))
    files = docs.where(n % 6 != 4).select(uid.alias("id"), F.lit("text.txt").alias("name"), F.col("text").cast("binary").alias("content"))
    library.import_entries(docs.select(n.alias("n"), broken.alias("entry")), files)
    return library.rows().select("id", "title", "has_text", "size_bytes", F.size(F.from_json("warnings", "array<map<string,string>>")).alias("n_warnings"), "text_sha256")
