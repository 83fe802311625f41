"""More registered queries: snippets by phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators import search
from pagestrata.plans import sql
from pagestrata.plans.registry import register
from pagestrata.sources import views

WIDTH = 10


@register(f"WITH {sql.windows('documents', 'doc_id', 'text', [['thin', 're'], ['so'], ['the', 'w']], WIDTH, '[', ']')} SELECT doc_id, n_phrases, snippet FROM windows")
def snippet_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FT-06/07, UD-11: windows that hold most of a query's words and phrases, phrases marked whole."""
    phrases = search.query_words("thin-re so the-w")
    window = search.best_window([F.col("text")], phrases, WIDTH, ("[", "]"))
    docs = views.table(spark, sf_dir, "documents").select("doc_id", window.alias("w")).where("w is not null")
    return docs.select("doc_id", F.col("w.n").cast("long").alias("n_phrases"), F.col("w.text").alias("snippet"))
