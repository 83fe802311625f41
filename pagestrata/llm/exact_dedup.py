"""Exact dedup by 128-bit content hashes, with DataFrame functions only.

Texts are equal when they are identical after every stretch of ASCII white space has
become one space. Rows are grouped by the 128-bit MD5 hash of that text; hash, row
number and SHA-256 travel, texts don't. Then bytes are compared inside the groups of two
or more: a group's texts are all equal when its least and its greatest text are, and both
come from partial aggregates, so a text that a third of all rows share sends one copy a
task and is never one task's work. Groups that hold different texts are parted by
SHA-256 and compared again.

Text is shuffled for rows of groups of two or more only, as long as the list of their
hashes is within BROADCAST_IDS; beyond, all texts are, once.

Defined cases: null text is empty, and empty texts are equal to each other; long texts are
hashed and compared whole; of equal texts the row with the smallest doc_id stays, rows
without doc_id come last, and of repeated rows of one doc_id the first one stays, so
exactly one row of a class stays; an empty table gives no rows; other columns pass through
drop_copies, whatever their names, and aren't read by exact_classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.tables import scratch, settle, small_side

#: ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"
BROADCAST_IDS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _unequal(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which texts (keys, norm) differ in their bytes."""
    return texts.groupBy(*keys).agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select(*keys)


def _classes(rows: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, sha) of rows (row, doc_id, text)."""
    norm = normalised(F.col("text"))
    sha = F.unhex(F.sha2(norm, 256))
    digests = settle(rows.select("row", "doc_id", hash_of(norm).alias("hash"), sha.alias("sha")))
    copies = settle(digests.groupBy("hash").count().where("count > 1").select("hash"))
    wanted = small_side(copies, copies.count(), BROADCAST_IDS)
    texts = rows.select(hash_of(norm).alias("hash"), sha.alias("sha"), norm.alias("norm")).join(wanted, "hash", "left_semi")
    collided = settle(_unequal(texts.select("hash", "norm"), ["hash"]))
    whole = F.lit(bytearray())
    if collided.isEmpty():
        keyed = digests.withColumn("part", whole)
    else:
        if not _unequal(texts.join(collided, "hash", "left_semi"), ["hash", "sha"]).isEmpty():
            raise ValueError("different texts have equal MD5 and SHA-256 hashes")
        marked = collided.withColumn("apart", F.lit(True))
        keyed = digests.join(marked, "hash", "left").withColumn("part", F.when(F.col("apart"), F.col("sha")).otherwise(whole)).drop("apart")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("first")
    groups = settle(keyed.groupBy("hash", "part").agg(F.count("*").alias("n"), first).where("n > 1"))
    return keyed.join(groups, ["hash", "part"], "left").select(
        "row",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"),
        "sha",
    )


def exact_classes(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs; hash_of is replaced by tests of collisions."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    with scratch(docs.sparkSession) as keep:
        return keep(_classes(rows, hash_of).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without later copies of a text. docs are written once, as their rows are numbered."""
    number = "row"
    while number in docs.columns:
        number = f"_{number}"
    with scratch(docs.sparkSession) as keep:
        numbered = keep(docs.withColumn(number, F.monotonically_increasing_id()))
        rows = numbered.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        lost = keep(_classes(rows, content_hash).where("not kept").select(F.col("row").alias(number)))
    return numbered.join(lost, number, "left_anti").select(*docs.columns)
