"""Kept indexes of the given tables: built by the first query that needs one, then read.

An index belongs to its input's files, their sizes and times; other files get another index. It
stands in the shared folder, and so later sessions with the same folder find it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.operators.text_index import LAYOUT, TextIndex
from pagestrata.sources import versions
from pagestrata.sources.tables import shared_folder


def kept(docs: DataFrame, name: str, key: list[str], columns: list[str]) -> TextIndex:
    spark = docs.sparkSession
    stamps = []
    for f in sorted(docs.inputFiles()):
        fs, at = versions.hadoop(spark, f)
        status = fs.getFileStatus(at)
        stamps.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    path = f"{shared_folder(spark)}/index{LAYOUT}-{name}-{hashlib.sha256(chr(10).join(stamps).encode()).hexdigest()[:24]}"
    if not versions.numbers(spark, path):
        try:
            return TextIndex.build(docs, path, key, columns)
        except versions.VersionConflict:
            pass  # another session has built it meanwhile
    return TextIndex(spark, path)


def library(archives: DataFrame) -> TextIndex:
    """Of active archives."""
    return kept(archives, "library", ["id"], ["title", "final_url", "domain", "body"])


def documents(docs: DataFrame) -> TextIndex:
    return kept(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")), "documents", ["id"], ["body"])


def posts(rows: DataFrame) -> TextIndex:
    return kept(rows, "posts", ["thread_key", "post_number"], ["author", "body"])


def pages(texts: DataFrame) -> TextIndex:
    return kept(texts, "pages", ["page_id"], ["title", "body"])


def archive_posts(rows: DataFrame) -> TextIndex:
    return kept(rows, "archive-posts", ["post_id"], ["author", "thread", "url", "body"])
