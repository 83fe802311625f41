"""Quality by an interpolated modified Kneser-Ney character model of trusted text.

Trusted text are the documents labelled with quality 1 and not toxic; one in
HELD_OUT of them, by a hash of the id, doesn't train the model but sets its limits.
One pass over all texts gives every distinct character 4-gram with its count in
trusted text and in bad text (labelled toxic or with quality 0), summed per task and
then per key; sharded count joins give every n-gram's bits under both models (see
ngram_table). A document's perplexity is 2 ** (bits per character), drawn towards
its language's mean for short texts; documents above a quantile of held-out trusted
documents of their language, plus a slack, are rejected. So are documents above such
limits of two more measures:

* contrast: the bits over BAD_BITS by which a character is likelier in bad text than
  in trusted text, summed and divided by the root of the length, so that few words of
  bad text in much plain text still count;
* the share of words that equal the word before them (words are what white space
  separates). Perplexity doesn't show these: a rare word over and over isn't cheap.

Defined cases: null or empty text has the neutral perplexity of its language and is
kept; null lang is a language of its own; a language without held-out trusted
documents takes the limits of all, and where nothing is held out all trusted
documents set them; without trusted documents everything is kept, and without bad
ones nothing is rejected by contrast; rows without doc_id are scored and kept; labels
repeated for one document count as trusted if any of them has quality 1 and none is
toxic, and otherwise as bad if any has quality 0 or is toxic; a value at a limit is
kept; repeated rows are each scored; an empty table gives no rows; long texts are
read whole, in runs of characters; other columns are not read, and pass
keep_quality() whatever their names.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.char_model import SPACE, units
from pagestrata.llm.ngram_table import TABLE_VALUES, count_keys, model_table, scored, total
from pagestrata.llm.tables import scratch, settle, small_side

BROADCAST_IDS = 2_000_000
#: Characters' worth of the language's mean that each text's mean is mixed with.
PRIOR_CHARS = 60
QUANTILE = 0.995
SLACK_BITS = 0.4
BAD_BITS = 4.0
BAD_SLACK = 1.0
#: Words' worth of no repeats that each text's share of repeats is mixed with.
PRIOR_WORDS = 20
REPEAT_SLACK = 0.05
#: One trusted document in so many sets limits only.
HELD_OUT = 8
#: The models of the table.
TRUSTED, BAD = 0, 1


def read(text: str | None) -> np.ndarray:
    """16-bit units of a text; each run of white space is one space."""
    u = units(text or "")
    white = (u == SPACE) | ((u >= 9) & (u <= 13)) | (u == 160)
    u[white] = SPACE
    return u[~(white & np.r_[True, white[:-1]])] if len(u) else u


def repeats(text: str | None) -> int:
    """How many words equal the word before, times 2 ** 32, and how many words there are."""
    words = (text or "").split()
    return (sum(map(eq, words, islice(words, 1, None))) << 32) + len(words)


def label_kinds(labels: DataFrame) -> DataFrame:
    """(doc_id, _kind): TRUSTED or BAD documents."""
    toxic = F.max(F.coalesce("toxic", F.lit(0))) != 0
    good = (F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")) == 1) & ~toxic
    bad = toxic | (F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int")) == 1)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.when(good, TRUSTED).when(bad, BAD).alias("_kind")).where("_kind is not null")


def excess(bits: np.ndarray) -> np.ndarray:
    """Bits in trusted text, and those over BAD_BITS that bad text would save."""
    return np.stack([bits[:, TRUSTED], np.maximum(bits[:, TRUSTED] - bits[:, BAD] - BAD_BITS, 0)], axis=1)


def judge_quality(docs: DataFrame, labels: DataFrame, table_values: int = TABLE_VALUES, quantile: float = QUANTILE, slack_bits: float = SLACK_BITS) -> DataFrame:
    """(doc_id, lang, length, perplexity, limit, keep) for every row of docs."""
    kinds = settle(label_kinds(labels).select(F.col("doc_id").alias("_id"), "_kind"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0
    trusted = F.coalesce(F.col("_kind") == TRUSTED, F.lit(False))
    flagged = rows.join(small_side(kinds, kinds.count(), BROADCAST_IDS), rows["doc_id"] == kinds["_id"], "left").select(
        "doc_id", "lang", "text", trusted.alias("trusted"), (trusted & held).alias("held"), F.when(trusted & held, -1).otherwise(F.coalesce("_kind", F.lit(-1))).cast("int").alias("kind")
    )
    counts = settle(count_keys(flagged, lambda: read))
    any_bad = bool(counts.where(F.col("kind") == BAD).head(1))
    table = model_table(counts, 2, modified=True)
    sums = scored(flagged.drop("kind"), table, 2, lambda: read, repeats, excess, table_values)
    found = settle(sums.select("doc_id", "lang", "trusted", "held", total(0).alias("total"), (total(1) if any_bad else F.lit(0.0)).alias("excess"), "length", F.shiftright("more", 32).alias("repeats"), F.col("more").bitwiseAND(F.lit(2**32 - 1)).alias("words")))
    own = found.where("trusted and length > 0")
    known = own.where("held") if own.where("held").head(1) else own

    average = F.sum("total") / F.sum("length")
    worse = F.col("excess") / F.sqrt(F.col("length") + PRIOR_CHARS)
    share = F.col("repeats") / (F.col("words") + PRIOR_WORDS)
    top = lambda value, name: F.percentile_approx(value, quantile, 10_000).alias(name)
    everyone = known.agg(average.alias("mean"), top(F.col("total") / F.col("length"), "limit"), top(worse, "excess"), top(share, "share")).first()
    if everyone["mean"] is None:
        return found.select("doc_id", "lang", "length", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("limit"), F.lit(True).alias("keep"))
    means = known.groupBy(F.col("lang").alias("_lang")).agg(average.alias("_mean"))
    own = (F.col("total") + PRIOR_CHARS * F.col("_mean")) / (F.col("length") + PRIOR_CHARS)
    per_lang = (
        known.join(F.broadcast(means), known["lang"].eqNullSafe(means["_lang"]))
        .groupBy("_lang")
        .agg(F.first("_mean").alias("_mean"), top(own, "_limit"), top(worse, "_excess"), top(share, "_share"))
    )
    both = found.join(F.broadcast(per_lang), found["lang"].eqNullSafe(per_lang["_lang"]), "left")
    mean = F.coalesce("_mean", F.lit(everyone["mean"]))
    limit = F.coalesce("_limit", F.lit(everyone["limit"])) + slack_bits
    bits = (F.col("total") + PRIOR_CHARS * mean) / (F.col("length") + PRIOR_CHARS)
    usual = (worse <= F.coalesce("_excess", F.lit(everyone["excess"])) + BAD_SLACK) & (share <= F.coalesce("_share", F.lit(everyone["share"])) + REPEAT_SLACK)
    keep = ((bits <= limit) & usual) | F.col("doc_id").isNull()
    return both.select("doc_id", "lang", "length", F.pow(F.lit(2.0), bits).alias("perplexity"), F.pow(F.lit(2.0), limit).alias("limit"), keep.alias("keep"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects."""
    with scratch(docs.sparkSession) as keep:
        out = keep(judge_quality(docs, labels).where("not keep").select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(small_side(out, out.count(), BROADCAST_IDS), docs["doc_id"] == out["_id"], "left_anti")
