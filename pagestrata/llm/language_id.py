"""Language ID by interpolated Kneser-Ney character models, one per language.

Counts of character 4-grams are gathered from all training rows, summed per task and
then per key over a shuffle, without a cap. One model per language is built from
them by sharded joins and held in sorted hash arrays (see ngram_table). A text's
language is the one of the lowest cross-entropy per character; calibrated rejection
flags texts whose cross-entropy lies above the given quantile of the training texts
of that language.

The distinct languages are a small set of names; their list is the only thing that
is collected besides the bounded table.

Texts are lower-cased; runs of characters that are not letters are one space.
Letters over U+FFFF are one symbol.
Defined cases: null text or no letter gives und with score 0; without training rows
every text gives und; rows without lang or doc_id teach nothing, and rows without
doc_id aren't held out; ties go to the first language in order of name; repeated
rows are scored each; an empty table gives no rows; long texts are read whole, in
runs of characters; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.char_model import SPACE, letters, units
from pagestrata.llm.ngram_table import TABLE_VALUES, count_keys, model_table, scored
from pagestrata.llm.tables import settle

HELD_OUT = 2
REJECT_ABOVE = 0.995
#: A text's characters count towards the score's sharpness up to here.
SHARP_CHARS = 40


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


class Reader:
    """Texts to 16-bit units: lower case, and one space for each run without letters."""

    def __init__(self):
        self.letters = letters()

    def __call__(self, text: str | None) -> np.ndarray:
        u = units((text or "").lower())
        space = ~self.letters[u]
        if len(far := np.flatnonzero(u == 0xFFFF)):
            lower = (text or "").lower()
            space[far] = [not lower[i].isalpha() for i in far]
        u[space] = SPACE
        return u[~(space & np.r_[True, space[:-1]])] if len(u) else u


#: Different values of lang in training rows from which lang is taken to be dirty: an error says so.
MOST_LANGUAGES = 2000


def has_letter(text: str | None) -> int:
    return int(any(map(str.isalpha, text or "")))


def identify(docs: DataFrame, table_values: int = TABLE_VALUES, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits, rejected) for every row of docs (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    teaches = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~F.col("held_out")
    names = [r["lang"] for r in rows.where(teaches).select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: they can't all be languages")
    if not names:
        none = F.lit(0.0)
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), none.alias("score"), none.alias("bits"), F.lit(True).alias("rejected"))
    which = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1
    kind = F.when(teaches, which).otherwise(-1).cast("int")
    table = model_table(settle(count_keys(rows.select(kind.alias("kind"), "text"), Reader)), len(names), modified=False)
    sums = settle(scored(rows, table, len(names), Reader, has_letter, table_values=table_values))
    bits = F.transform("totals", lambda t: t / F.greatest(F.col("length"), F.lit(1)))
    sharp = F.least(F.col("length"), F.lit(SHARP_CHARS)) * float(np.log(2))
    least = F.array_min("_bits")
    share = 1 / F.aggregate(F.transform("_bits", lambda b: F.exp(-(b - least) * sharp)), F.lit(0.0), lambda a, x: a + x)
    real = F.col("more") > 0
    judged = sums.withColumn("_bits", bits).select(
        "doc_id",
        "held_out",
        "lang",
        F.when(real, F.get(F.array(*[F.lit(x) for x in names]), (F.array_position("_bits", least) - 1).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(real, share).otherwise(0.0).alias("score"),
        least.alias("bits"),
    )
    own = judged.where((F.col("lang") == F.col("lang_pred")) & ~F.col("held_out"))
    # one row a language: this broadcast is bounded
    limits = own.groupBy("lang_pred").agg(F.percentile_approx("bits", reject_above, 10_000).alias("_limit"))
    return judged.join(F.broadcast(limits), "lang_pred", "left").select(
        "doc_id", "held_out", "lang_pred", "score", "bits", (F.coalesce(F.col("bits") > F.col("_limit"), F.lit(True))).alias("rejected")
    )
