"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts are lower-cased and split into words of letters and digits, each hashed to 64
bits. A seed is the hash of the words that a fixed mask marks; words where a mask
has 0 may differ. Seeds of documents join seeds of benchmark items; hits of one
document and item on one diagonal are one candidate, whatever their number. A
candidate is verified on the words themselves: the longest window along the
diagonal with MIN_EQUAL of its words equal is the overlap, found by halving for each
place it may end at. A document is contaminated by an item if an overlap spans MIN_WORDS
words, or all words of a shorter item, with MIN_EQUAL of them equal.

Spark broadcasts the benchmark's seeds only while they are under its size limit,
and joins by shuffle, with skewed keys split, beyond.

Defined cases: null or empty texts and items have no words and match nothing; items
shorter than the shortest mask have no seed and match nothing; rows without doc_id
or item_id take no part (such documents are kept); repeated rows of an id count
once in results; of equally long overlaps the one with more equal words, then the
first, is reported; empty tables give no overlaps and keep every document; long texts
and items are compared whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.tables import scratch, settle, small_side

#: Marked words of each mask: 11101011 and 110100111.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
MIN_WORDS = 13
MIN_EQUAL = 0.8
BROADCAST_IDS = 2_000_000
#: Places summed at a time along a diagonal.
BLOCK = 64


def words_of(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def hashed_words(rows: DataFrame, key: str) -> DataFrame:
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), hashed.alias("words"))


def seeds(rows: DataFrame, key: str) -> DataFrame:
    """(key, mask, at, seed) of rows (key, words)."""

    def of(mask: tuple[int, ...]) -> Column:
        last = F.size("words") - 1 - mask[-1]
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in mask]))

    both = rows.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), of(x).alias("seeds")) for m, x in enumerate(MASKS)])).alias("m"))
    return both.select(key, F.col("m.mask").alias("mask"), F.posexplode("m.seeds").alias("at", "seed"))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift): diagonals, document position minus item position, on which seeds agree."""
    own = settle(seeds(hashed_words(items, "item_id"), "item_id").select("mask", "seed", "item_id", F.col("at").alias("item_at")).distinct())
    hits = seeds(hashed_words(docs, "doc_id"), "doc_id").join(own, ["mask", "seed"])
    return hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def running_sums(same: Column, min_equal: float) -> Column:
    """(equal, low) before the first and after each place of same (1: equal words, 0: others).

    equal: equal words up to there; low: the least surplus (equal words less min_equal a
    word) up to there. Arrays grow within a block of BLOCK places and from block to block,
    so that a long text doesn't copy its sums for each word.
    """
    n = F.size(same)
    zero = F.struct(F.array().cast("array<int>").alias("equal"), F.array().cast("array<double>").alias("low"))

    def step(acc: Column, hit: Column) -> Column:
        equal = F.coalesce(F.try_element_at(acc["equal"], F.lit(-1)), F.lit(0)) + hit
        surplus = equal - min_equal * (F.size(acc["equal"]) + 1)
        return F.struct(F.array_append(acc["equal"], equal).alias("equal"), F.array_append(acc["low"], F.least(F.try_element_at(acc["low"], F.lit(-1)), surplus)).alias("low"))

    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda b: F.aggregate(F.slice(same, b * BLOCK + 1, BLOCK), zero, step))

    def carry(acc: Column, block: Column) -> Column:
        """Before each block: equal words, and the least surplus; the last entry is what follows the last block."""
        before = F.element_at(acc, -1)
        at = before["at"] + F.size(block["equal"])
        low = F.least(before["low"], before["equal"] - min_equal * before["at"] + F.element_at(block["low"], -1))
        return F.array_append(acc, F.struct(at.alias("at"), (before["equal"] + F.element_at(block["equal"], -1)).alias("equal"), low.alias("low")))

    start = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("equal"), F.lit(0.0).alias("low")))
    carried = lambda made: F.zip_with(made, F.slice(F.aggregate(made, start, carry), 1, F.size(made)), lambda m, c: F.struct(m.alias("m"), c.alias("c")))

    def spread(both: Column) -> Column:
        equal = F.transform(both, lambda x: F.transform(x["m"]["equal"], lambda e: e + x["c"]["equal"]))
        low = F.transform(both, lambda x: F.transform(x["m"]["low"], lambda v: F.least(x["c"]["low"], x["c"]["equal"] - min_equal * x["c"]["at"] + v)))
        return F.struct(F.concat(F.array(F.lit(0)), F.flatten(equal)).alias("equal"), F.concat(F.array(F.lit(0.0)), F.flatten(low)).alias("low"))

    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return once(once(blocks, carried), spread)


def overlap(words: Column, item: Column, shift: Column, min_equal: float = MIN_EQUAL) -> Column:
    """(start, n, equal) of the longest window along the diagonal with min_equal of its words equal, in words of the item; n is 0 without one."""
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(words) - shift) - 1
    same = F.transform(F.sequence(first, last), lambda i: (F.get(item, i) == F.get(words, i + shift)).cast("int"))
    sums = running_sums(same, min_equal)

    def longest(acc: Column) -> Column:
        halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(acc["low"]) + 1)).cast("int"))

        def ending(equal: Column, at: Column) -> Column:
            # the first place whose surplus isn't over the one here begins the longest window that ends here; low never rises, so halving finds it
            most = equal - min_equal * at + 1e-9
            both = F.struct(F.lit(0).alias("from"), at.alias("to"))

            def halve(b: Column, _: Column) -> Column:
                middle = F.floor((b["from"] + b["to"]) / 2).cast("int")
                over = F.get(acc["low"], middle) > most
                return F.struct(F.when(over, F.least(middle + 1, b["to"])).otherwise(b["from"]).alias("from"), F.when(over, b["to"]).otherwise(middle).alias("to"))

            begin = F.aggregate(halvings, both, halve, lambda b: b["from"])
            return F.struct((at - begin).alias("n"), (equal - F.get(acc["equal"], begin)).alias("equal"), (-begin).alias("minus"))

        return F.array_max(F.transform(acc["equal"], ending))

    # one step, so that the sums are made once and then looked up
    best = F.element_at(F.transform(F.array(sums), longest), 1)
    return F.struct((first - best["minus"]).alias("start"), best["n"].alias("n"), best["equal"].alias("equal"))


def contaminated(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_equal): the longest verified overlap of each document and item."""
    found = settle(candidates(docs, items))
    hit = settle(found.select("doc_id").distinct())
    near = hashed_words(docs.join(small_side(hit, hit.count(), BROADCAST_IDS), "doc_id", "left_semi"), "doc_id")
    wanted = hashed_words(items, "item_id").withColumnRenamed("words", "item")
    # each diagonal takes along only the words that lie beside its item; cut says how many words of the document come before them
    sized = found.join(wanted.select("item_id", F.size("item").alias("item_n")), "item_id")
    cut = F.greatest(F.lit(0), F.col("shift"))
    beside = F.slice("words", cut + 1, F.greatest(F.lit(0), F.col("shift") + F.col("item_n") - cut))
    pairs = sized.join(near, "doc_id").select("doc_id", "item_id", "shift", "item_n", cut.alias("cut"), beside.alias("words")).join(wanted, "item_id")
    shift = F.col("shift") - F.col("cut")
    pairs = pairs.where(F.least(F.size("item"), F.size("words") - shift) > F.greatest(F.lit(0), -shift))
    held = pairs.select("doc_id", "item_id", "shift", "item_n", overlap(F.col("words"), F.col("item"), shift, min_equal).alias("o"))
    enough = (F.col("o.n") >= F.least(F.lit(min_words), F.col("item_n"))) & (F.col("o.equal") >= min_equal * F.col("o.n") - 1e-9)
    best = F.max(F.struct(F.col("o.n").alias("n"), F.col("o.equal").alias("equal"), (-(F.col("o.start") + F.col("shift"))).alias("minus")))
    return (
        held.where(enough)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", (-F.col("b.minus")).alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.equal").alias("n_equal"))
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that a benchmark item contaminates."""
    with scratch(docs.sparkSession) as keep:
        out = keep(contaminated(docs, items).select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(small_side(out, out.count(), BROADCAST_IDS), docs["doc_id"] == out["_id"], "left_anti")
