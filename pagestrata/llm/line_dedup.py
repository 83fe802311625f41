"""Line dedup by sharded minimal perfect hashes.

The distinct keys of lines that several documents hold are hashed to 128 bits and
dealt to shards by their hash. Each shard is one minimal perfect hash (levels of
bit vectors, a key rests at the first level where no other key shares its slot)
over compact arrays: a fingerprint, a count (of rows, for dealing probes) and the
smallest document for each key. Documents send the hashes of their lines to the shards and
probe the arrays; lines are never joined with lines.

A shard holds about KEYS_PER_SHARD probes. A key that a large part of all
documents hold sends more probes to its shard; such a shard's arrays (some 100
kB) are copied and its probes are dealt out by document over the copies.

Defined cases: null or empty text is one empty line; lines with short keys stay;
rows without doc_id stay as they are and count for no one; repeated rows of one
doc_id count as one document and are treated alike; a line that several documents
hold stays in the smallest doc_id, each time it stands there; long texts are split
whole; an empty table gives no rows; other columns pass through, whatever their
names, but for those that a function says it replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.tables import scratch, settle
from pagestrata.llm.words import GOLDEN, mix

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY_CHARS = 10
KEYS_PER_SHARD = 8192
GAMMA = 1.5
SHARD = "shard long, levels binary, sizes binary, fingerprints binary, counts binary, keepers binary, copies long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + np.uint64(level + 1) * GOLDEN) % np.uint64(size)).astype(np.int64)


def join_hashes(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h1.view(np.uint64) * GOLDEN + mix(h2.view(np.uint64))


def build_perfect(h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bit vectors, and each key's rank among all set bits (its index)."""
    levels, left, index = [], np.arange(len(h)), np.empty(len(h), np.int64)
    base = 0
    while len(left):
        size = max(8, int(GAMMA * len(left)) + 1)
        slots = place(h[left], len(levels), size)
        alone = np.bincount(slots, minlength=size) == 1
        rests = alone[slots]
        index[left[rests]] = base + np.cumsum(alone)[slots[rests]] - 1
        base += int(alone.sum())
        levels.append(alone)
        left = left[~rests]
        if len(levels) > 400:
            raise ValueError("two keys of a shard fold to the same 64 bits")
    return levels, index


def find_perfect(levels: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """The index of each hash, -1 where no level has its bit; only a fingerprint tells whether a key is known."""
    found, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, alone in enumerate(levels):
        if not len(left):
            break
        slots = place(h[left], level, len(alone))
        rests = alone[slots]
        found[left[rests]] = base + np.cumsum(alone)[slots[rests]] - 1
        base += int(alone.sum())
        left = left[~rests]
    return found


def _build(shard: pa.Table) -> pa.Table:
    h1, h2, n, keep = (shard[c].to_numpy() for c in ("h1", "h2", "n", "keeper"))
    levels, index = build_perfect(join_hashes(h1, h2))
    order = np.argsort(index)
    sizes = np.array([len(x) for x in levels], np.int64)
    copies = 1 + int(n.sum()) // KEYS_PER_SHARD
    return pa.table(
        {
            "shard": shard["shard"][:1],
            "levels": [np.packbits(np.concatenate(levels)).tobytes()],
            "sizes": [sizes.tobytes()],
            "fingerprints": [h2[order].tobytes()],
            "counts": [n[order].tobytes()],
            "keepers": [keep[order].tobytes()],
            "copies": [copies],
        },
        schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in ("levels", "sizes", "fingerprints", "counts", "keepers")], ("copies", pa.int64())]),
    )


PROBED = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64())])


def _probe(probes: pa.Table, shards: pa.Table) -> pa.Table:
    if not probes.num_rows or not shards.num_rows:
        return PROBED.empty_table()
    row = shards.slice(0, 1).to_pylist()[0]
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["levels"], np.uint8), count=int(sizes.sum())).astype(bool)
    levels = np.split(bits, np.cumsum(sizes)[:-1])
    doc, h1, h2 = (probes[c].to_numpy() for c in ("doc_id", "h1", "h2"))
    at = find_perfect(levels, join_hashes(h1, h2))
    known = at >= 0
    known[known] = np.frombuffer(row["fingerprints"], np.int64)[at[known]] == h2[known]
    drop = known.copy()
    drop[known] = np.frombuffer(row["keepers"], np.int64)[at[known]] != doc[known]
    return pa.table({"doc_id": doc[drop], "h1": h1[drop]}, schema=PROBED)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, dropped): sorted hashes of the lines that each document loses; documents that lose none are absent."""
    with scratch(docs.sparkSession) as keep:
        return keep(_repeated_lines(docs, min_chars))


def _repeated_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: F.char_length(k) >= min_chars))
    probes = settle(
        docs.select("doc_id", "text").where("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(keys).alias("k"))
        .select("doc_id", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))
    )
    n_shards = 1 + probes.count() // KEYS_PER_SHARD
    probes = probes.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    held = (
        probes.groupBy("shard", "h1", "h2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        .where("keeper < last")
    )
    shards = settle(held.groupBy("shard").applyInArrow(_build, SHARD))
    hot = shards.where("copies > 1").select("shard", "copies")
    dealt = probes.join(hot, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.coalesce("copies", F.lit(1))))
    copied = shards.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    hits = (
        dealt.select("shard", "copy", "doc_id", "h1", "h2")
        .groupBy("shard", "copy")
        .cogroup(copied.groupBy("shard", "copy"))
        .applyInArrow(_probe, "doc_id long, h1 long")
    )
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("h1")).alias("dropped"))


def in_sorted(values: Column, x: Column) -> Column:
    """Whether sorted values have x, by halving; short arrays are read through."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def halve(b: Column, _: Column) -> Column:
        middle = F.floor((b["low"] + b["high"]) / 2).cast("int")
        under = F.get(values, middle) < x
        return F.struct(F.when(under, F.least(middle + 1, b["high"])).otherwise(b["low"]).alias("low"), F.when(under, b["high"]).otherwise(middle).alias("high"))

    first = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve, lambda b: b["low"])
    return F.when(F.size(values) <= 16, F.array_contains(values, x)).otherwise(F.coalesce(F.get(values, first) == x, F.lit(False)))


def _judged(docs: DataFrame, min_chars: int) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are returned: the lines, and those of them that stay."""

    def fresh(name: str) -> str:
        return name if name not in docs.columns else fresh(f"_{name}")

    key, lost, lines, kept = (fresh(f"_{c}") for c in ("id", "dropped", "lines", "kept"))
    gone = repeated_lines(docs, min_chars).select(F.col("doc_id").alias(key), F.col("dropped").alias(lost))
    both = docs.join(gone, docs["doc_id"] == gone[key], "left").drop(key).withColumn(lines, lines_of(docs["text"]))
    # key and hash as variables, so that halving doesn't make them anew at each step
    goes = lambda key: (F.char_length(key) >= min_chars) & F.exists(F.array(F.xxhash64(key)), lambda h: in_sorted(F.col(lost), h))
    stays = lambda line: ~F.exists(F.array(key_of(line)), goes)
    return both.withColumn(kept, F.when(F.col(lost).isNull(), F.col(lines)).otherwise(F.filter(lines, stays))).drop(lost), lines, kept


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """docs with n_lines (before), n_dropped and kept_text beside their other columns; columns of these names are replaced."""
    found, lines, kept = _judged(docs, min_chars)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    n = F.size(lines).cast("long")
    return found.select(*own, n.alias("n_lines"), (n - F.size(kept)).alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """docs whose texts have lost the lines that an earlier document has; n_chars, if there, follows the text."""
    found, lines, kept = _judged(docs, min_chars)
    lost = F.size(kept) < F.size(lines)
    text = F.array_join(kept, "\n")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[F.when(lost, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else c for c in docs.columns])
