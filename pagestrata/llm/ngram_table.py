"""Interpolated Kneser-Ney character models as tables, built by sharded count joins, and texts scored by them.

The table has a row for every character 4-gram of any text, with its bits
(-log2 p) under each of a few models. Counts of lower orders, context totals and
discounts follow by groupings of the counts, probabilities by joins of counts,
contexts and the next lower order, all sharded by model and key. In tasks the table
is held as sorted hash arrays: broadcast where it is counted to hold TABLE_VALUES
values at most; beyond, texts and the rows of their own n-grams are dealt to blocks
and meet there. Both ways give the same sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.llm.char_model import ORDER, Scorer, chunks, merged
from pagestrata.llm.tables import settle

TABLE_VALUES = 12_000_000
BLOCK_DOCS = 4096
#: Distinct n-grams that a task gathers before it gives them on.
GATHERED = 10_000_000
COUNTS = pa.schema([("kind", pa.int32()), ("k", pa.int64()), ("n", pa.int64())])
Reader = Callable[[str | None], np.ndarray]


def count_keys(docs: DataFrame, reader: Callable[[], Reader]) -> DataFrame:
    """(kind, k, n) of docs (kind int, text): 4-grams with their counts, 0 where kind is negative."""

    def count(batches):
        read, found = reader(), {}

        def give():
            for kind, runs in found.items():
                k, n = merged(runs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n if kind >= 0 else np.zeros(len(k), np.int64))], schema=COUNTS)

        for batch in batches:
            texts, kinds = batch.column("text"), batch.column("kind").to_numpy(zero_copy_only=False)
            for kind in np.unique(kinds).tolist():
                runs = found.setdefault(kind, [])
                for _, k, _ in chunks((0, read(texts[int(i)].as_py())) for i in np.flatnonzero(kinds == kind)):
                    runs.append(np.unique(k, return_counts=True))
                if len(runs) > 8:
                    runs[:] = [merged(runs)]
            if sum(len(k) for runs in found.values() for k, _ in runs) > GATHERED:
                yield from give()
                found.clear()
        yield from give()

    return docs.select("kind", "text").mapInArrow(count, "kind int, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n"))


def discounted(level: DataFrame, modified: bool) -> DataFrame:
    """(m, d1, d2, d3): discounts of counts 1, 2 and more per model, from how many n-grams occur once to four times."""
    n = [F.col(f"n{i}") for i in range(5)]
    own = level.groupBy("m").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = n[1] / (n[1] + 2 * n[2])
    if not modified:
        return own.select("m", *[F.when((n[1] > 0) & (n[2] > 0), y).otherwise(0.5).alias(f"d{i}") for i in (1, 2, 3)])
    full = (n[1] > 0) & (n[2] > 0) & (n[3] > 0) & (n[4] > 0)
    kept = lambda i: F.least(F.greatest(i - (i + 1) * y * n[i + 1] / n[i], F.lit(0.05)), F.lit(i - 0.05))
    return own.select("m", *[F.when(full, kept(i)).otherwise(d).alias(f"d{i}") for i, d in ((1, 0.5), (2, 0.75), (3, 0.9))])


def bits_of(counts: DataFrame, modified: bool) -> DataFrame:
    """(m, k, bits) of every 4-gram of counts (m, k, n), n being 0 where a model has not seen it."""
    low = lambda order: F.col("k").bitwiseAND(F.lit((1 << 16 * order) - 1))
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        level = levels[-1].groupBy("m", low(order).alias("k")).agg(F.count_if(F.col("n") > 0).alias("n"))
        levels.append(settle(level) if order == ORDER - 1 else level)
    p = None
    for order, level in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        # one row a model: these broadcasts are bounded
        by = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = level.join(F.broadcast(discounted(level, modified)), "m").select("m", "k", "n", F.shiftrightunsigned("k", 16).alias("c"), by.alias("by"))
        held = cut.where("n > 0").groupBy("m", "c").agg(F.sum("n").alias("total"), F.sum("by").alias("mass"))
        both = cut.join(held, ["m", "c"], "left")
        if p is None:
            both = both.join(F.broadcast(level.groupBy("m").agg((1.0 / (F.count("*") + 1)).alias("lower"))), "m")
        else:
            both = both.withColumn("s", low(order - 1)).join(p.select("m", F.col("k").alias("s"), F.col("p").alias("lower")), ["m", "s"])
        own = F.when(F.col("n") > 0, F.col("n") - F.col("by")).otherwise(0.0)
        p = both.select("m", "k", F.when(F.col("total").isNull(), F.col("lower")).otherwise((own + F.col("mass") * F.col("lower")) / F.col("total")).alias("p"))
    return p.select("m", "k", (-F.log2("p")).alias("bits"))


def model_table(counts: DataFrame, models: int, modified: bool) -> DataFrame:
    """(k, bits): an array of the bits under models 0 to models - 1 for every 4-gram of counts (kind, k, n)."""
    wide = counts.groupBy("k").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == m, F.col("n"))), F.lit(0)).alias(f"n{m}") for m in range(models)])
    long = settle(wide.select("k", F.posexplode(F.array(*[f"n{m}" for m in range(models)])).alias("m", "n")))
    each = bits_of(long, modified).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("m", "bits"))).alias("b"))
    return settle(each.select("k", F.transform("b", lambda x: x["bits"]).alias("bits")))


def _arrays(table: pa.Table, models: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their rows of bits."""
    k = table["k"].to_numpy().view(np.uint64)
    lists = table["bits"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks or [pa.array([], pa.list_(pa.float64()))])
    order = np.argsort(k)
    return k[order], lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, models)[order]


def scored(docs: DataFrame, table: DataFrame, models: int, reader: Callable[[], Reader], of_text: Callable[[str | None], int] = lambda text: 0, derive=None, table_values: int = TABLE_VALUES) -> DataFrame:
    """docs with totals (summed values per model), length and more (of_text) in place of text.

    derive turns rows of bits into the rows of values that are summed, of equal width.
    """
    out = T.StructType([*[f for f in docs.schema if f.name != "text"], *T._parse_datatype_string("totals array<double>, length long, more long").fields])
    names = [f.name for f in out][:-3]

    def judged(rows: pa.RecordBatch | pa.Table, scorer: Scorer, read: Reader) -> list:
        texts = [t.as_py() for t in rows.column("text")]
        total, length = scorer.sums(((i, read(t)) for i, t in enumerate(texts)), len(texts))
        ends = np.arange(len(texts) + 1, dtype=np.int32) * models
        totals = pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))
        return [*[rows.column(c) for c in names], totals, pa.array(length), pa.array([of_text(t) for t in texts], pa.int64())]

    def scorer_of(k: np.ndarray, bits: np.ndarray) -> Scorer:
        values = derive(bits) if derive else bits
        return Scorer(lambda wanted: values[np.searchsorted(k, wanted)], models)

    if table.count() * (1 + models) <= table_values:
        shared = docs.sparkSession.sparkContext.broadcast(_arrays(table.toArrow(), models))

        def judge(batches):
            scorer, read = scorer_of(*shared.value), reader()
            for batch in batches:
                yield pa.RecordBatch.from_arrays(judged(batch, scorer, read), names=out.names)

        return docs.mapInArrow(judge, out)

    def distinct(batches):
        read = reader()
        for batch in batches:
            for text, block in zip(batch.column("text"), batch.column("_block").to_pylist(), strict=True):
                for _, k, _ in chunks([(0, read(text.as_py()))]):
                    k = np.unique(k).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k)], names=["_block", "k"])

    def meet(texts: pa.Table, own: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(judged(texts, scorer_of(*_arrays(own, models)), reader()), names=out.names)

    # dealt by row, so that repeated rows are not one block
    dealt = settle(docs.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 + docs.count() // BLOCK_DOCS))))
    wanted = dealt.select("_block", "text").mapInArrow(distinct, "_block long, k long").distinct().join(table, "k")
    return dealt.groupBy("_block").cogroup(wanted.groupBy("_block")).applyInArrow(meet, out)


def total(m: int) -> Column:
    return F.get("totals", m)
