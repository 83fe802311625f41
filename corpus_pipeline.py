"""A corpus from raw documents to packed sequences: STAGES, each on what the stage before it kept.

Every stage but the last keeps the columns of documents, whatever else they have, and takes null and
empty texts, very long texts, repeated rows and empty tables as its operator's docstring states:
rows without doc_id, and documents without text, pass the filtering stages; of a group of near
copies the smallest doc_id stays, with all rows of that id; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagestrata.llm.decontaminate import keep_clean
from pagestrata.llm.line_dedup import without_repeated_lines
from pagestrata.llm.minhash_dedup import keep_one_of_each
from pagestrata.llm.packing import pack
from pagestrata.llm.quality_model import keep_quality
from pagestrata.llm.tables import scratch, settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; n_chars follows the text."""
    return without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

#: The model of the first stage, sketches and tokens can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; the copies that stages leave for each other are deleted when it is written."""
    with scratch(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = settle(stage(spark, docs, sf_dir))
        return keep(STAGES[-1][1](spark, docs, sf_dir))
