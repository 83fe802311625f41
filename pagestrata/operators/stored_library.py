"""The library as a kept table: schema steps, inserts, updates, soft deletes, imports and the history of captures.

Changes rewrite nothing but the buckets of their ids (sources.keyed_table); each is one published version, so a
change that fails leaves the library as it was. The version of the schema stands beside the table,
and steps run in order, once, and all together or not at all.

Defined cases: an insert of an id that is there, deleted or not, is skipped; changes of ids that aren't
there do nothing; of several changes of one field the last by seq holds, and a delete stays; rows from before a
schema step have nulls in its columns; import entries that aren't JSON objects, or whose fields have wrong types, fail.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators.library import STATUSES, is_archive_id
from pagestrata.sources.keyed_table import KeyedTable

#: Columns of the first schema, and what each later version adds.
FIRST = "id string, canonical_url string, title string, domain string, visited_at string, status string, tags string, warnings string, size_bytes long, has_mhtml boolean, has_screenshot boolean, has_text boolean, deleted boolean"
STEPS = {2: "mhtml_sha256 string, screenshot_sha256 string, text_sha256 string"}
CURRENT = max(STEPS)

# Fixed values of the format: fields of an export's entries by type, the files that an entry may claim, and what a dropped file leaves.
STRINGS = ("id", "canonicalUrl", "originalUrl", "finalUrl", "title", "domain", "capturedAt", "visitedAt", "appVersion")
NULLABLE_STRINGS = ("referrerUrl", "mhtmlSha256", "screenshotSha256", "textSha256")
NUMBERS, BOOLEANS = ("sizeBytes", "schemaVersion"), ("hasMhtml", "hasScreenshot", "hasText", "hasFavicon")
FILES = {"mhtml": ("page.mhtml", "hasMhtml", "mhtmlSha256"), "screenshot": ("screenshot.png", "hasScreenshot", "screenshotSha256"), "text": ("text.txt", "hasText", "textSha256")}
DROPPED_CODE, DROPPED_MESSAGE = "import-content-missing", "%s could not be verified during import and was dropped"


def schema_of(version: int) -> str:
    return ", ".join([FIRST, *[added for v, added in sorted(STEPS.items()) if v <= version]])


def valid_entry(entry: Column) -> Column:
    """Whether a variant has the shape of an exported archive: each of its fields there and of its type."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get(entry, f"$.{f}", "variant"))
    text = lambda f: F.try_variant_get(entry, f"$.{f}", "string")
    checks = [kind(f) == "STRING" for f in STRINGS]
    checks += [kind(f).isin("STRING", "VOID") for f in NULLABLE_STRINGS]
    checks += [kind(f).rlike(r"^(BIGINT|DOUBLE|DECIMAL\()") for f in NUMBERS]
    checks += [kind(f) == "BOOLEAN" for f in BOOLEANS]
    checks += [(kind("status") == "STRING") & text("status").isin(*STATUSES), kind("warnings").startswith("ARRAY<"), kind("tags").startswith("ARRAY<")]
    checks.append(F.forall(F.try_variant_get(entry, "$.tags", "array<variant>"), lambda t: F.schema_of_variant(t) == "STRING"))
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


class StoredLibrary:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = KeyedTable(spark, f"{path}/archives")

    @classmethod
    def create(cls, spark: SparkSession, path: str, version: int = CURRENT) -> StoredLibrary:
        KeyedTable.create(spark, f"{path}/archives", schema_of(version), ["id"], info={"schema": version})
        return cls(spark, path)

    @property
    def schema_version(self) -> int:
        return self.table.info["schema"]

    def migrate(self, to: int = CURRENT) -> int:
        """Runs the steps above the stored version up to another, in one change; the version afterwards."""
        if self.schema_version < to:
            self.table.evolve(schema_of(to), {"schema": to})
        return self.schema_version

    def rows(self) -> DataFrame:
        return self.table.read()

    def active(self) -> DataFrame:
        return self.rows().where(~F.col("deleted"))

    def _filled(self, rows: DataFrame) -> DataFrame:
        """rows with all columns of the library; those that they lack have their first values."""
        first = {"tags": F.lit("[]"), "warnings": F.lit("[]"), "deleted": F.lit(False), "size_bytes": F.lit(0), "has_mhtml": F.lit(False), "has_screenshot": F.lit(False), "has_text": F.lit(False)}
        fields = self.spark.createDataFrame([], schema_of(self.schema_version)).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else first.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields])

    def insert(self, rows: DataFrame) -> None:
        """Archives come in, but for ids that are there."""
        self.table.put(self._filled(rows).join(self.table.lookup(rows).select("id"), "id", "left_anti"))

    def change(self, changes: DataFrame) -> None:
        """changes: (id, seq, op, value), op being title, tags, size, status or delete."""
        of = lambda op: F.max_by(F.when(F.col("op") == op, F.col("value")), F.when(F.col("op") == op, F.col("seq")))
        last = changes.groupBy("id").agg(*[of(op).alias(f"_{op}") for op in ("title", "tags", "size", "status")], F.max(F.col("op") == "delete").alias("_gone_now"))
        known = self.table.lookup(changes).join(last, "id")
        new = {"title": F.coalesce("_title", "title"), "tags": F.coalesce("_tags", "tags"), "size_bytes": F.coalesce(F.col("_size").cast("long"), "size_bytes"), "status": F.coalesce("_status", "status"), "deleted": F.col("deleted") | F.col("_gone_now")}
        self.table.put(known.withColumns(new).drop("_title", "_tags", "_size", "_status", "_gone_now"))

    def import_entries(self, entries: DataFrame, files: DataFrame) -> DataFrame:
        """Takes in an export's entries (n, entry: JSON text) with files (id, name, content: binary), and gives (n, id, outcome).

        Entries of a wrong shape fail, ids that are there are skipped, and of one id twice the first is taken. A file that is
        missing or whose bytes have another hash is dropped with a warning; the size is that of what was kept.
        """
        read = entries.select("n", F.try_parse_json("entry").alias("v"))
        get = lambda f, kind="string": F.try_variant_get("v", f"$.{f}", kind)
        shaped = read.select("n", valid_entry(F.col("v")).alias("shaped"), get("id").alias("id"), "v").withColumn("shaped", F.col("shaped") & F.coalesce(is_archive_id(F.col("id")), F.lit(False)))
        first = shaped.where("shaped").groupBy("id").agg(F.min("n").alias("_first"))
        there = self.table.lookup(shaped.select("id")).select("id", F.lit(True).alias("_there"))
        judged = shaped.join(first, "id", "left").join(there, "id", "left")
        outcome = F.when(~F.col("shaped"), "failed").when(F.col("_there") | (F.col("n") != F.col("_first")), "skipped").otherwise("imported")
        path = f"{self.path}/imports/{uuid.uuid4().hex}"  # stays as the import's record
        judged.withColumn("outcome", outcome).select("n", "id", "outcome", "v").withColumn("v", F.to_json("v")).write.parquet(path)
        settled = self.spark.read.schema("n long, id string, outcome string, v string").parquet(path)
        taken = settled.where("outcome = 'imported'").withColumn("v", F.parse_json("v"))
        hashed = files.select("id", "name", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("n_bytes"))
        have = hashed.groupBy("id").agg(*[F.max(F.when(F.col("name") == name, F.struct("sha", "n_bytes"))).alias(f"_{kind}") for kind, (name, _, _) in FILES.items()])
        both = taken.join(have, "id", "left")
        kept = {k: get(claim, "boolean") & F.col(f"_{k}").isNotNull() & (get(sha).isNull() | (get(sha) == F.col(f"_{k}.sha"))) for k, (_, claim, sha) in FILES.items()}
        kept = {k: F.coalesce(v, F.lit(False)) for k, v in kept.items()}
        lost = F.array_compact(F.array(*[F.when(get(claim, "boolean") & ~kept[k], F.to_json(F.struct(F.lit(DROPPED_CODE).alias("code"), F.lit(DROPPED_MESSAGE % name).alias("message")))) for k, (name, claim, _) in FILES.items()]))
        before = F.array(F.substring(get("warnings"), F.lit(2), F.char_length(get("warnings")) - 2))
        warnings = F.array_join(F.filter(F.concat(before, lost), lambda w: w != ""), ",")
        rows = both.select(
            "id",
            get("canonicalUrl").alias("canonical_url"),
            *[get(f).alias(f) for f in ("title", "domain", "status", "tags")],
            get("visitedAt").alias("visited_at"),
            F.concat(F.lit("["), warnings, F.lit("]")).alias("warnings"),
            sum((F.when(kept[k], F.col(f"_{k}.n_bytes")).otherwise(0) for k in FILES), F.lit(0).cast("long")).alias("size_bytes"),
            *[kept[k].alias(f"has_{k}") for k in FILES],
            *[F.when(kept[k], get(sha)).alias(f"{k}_sha256") for k, (_, _, sha) in FILES.items()],
        )
        self.insert(rows)
        return settled.select("n", "id", "outcome")


def upsert(table: KeyedTable, rows: DataFrame, order: str) -> None:
    """Rows come in or replace those of their key; of several of one key the one with the greatest order."""
    newest = rows.groupBy(*table.key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    table.put(newest)

