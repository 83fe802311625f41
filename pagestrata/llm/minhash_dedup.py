"""Near-duplicate classes by HyperMinHash sketches, banding and exact verification.

A document's set is its distinct hashed shingles. Equal sets are one class from the
start: only the class's smallest document goes on, whatever the number of copies.

A sketch has BUCKETS registers. Every shingle falls in a bucket by its hash and the
smallest remainder of each bucket is kept as a count of leading zeros (6 bits) and
the next 10 bits, two bytes in all. Sets of fewer than FILL shingles insert every
shingle several times under different seeds (a power of two, the set's level), so
that no bucket stays empty and a register agrees with probability J for sets of any
size; sets near the border of two levels are sketched for both, so two sets of
similarity 0.8 always meet on one level.

BANDS bands of ROWS registers make candidates: a pair of similarity 0.8 misses all
with probability (1 - 0.8**4)**32, or 5e-8. In the first HUB_BANDS bands each member
of a bucket is paired with the least one only; pairs whose collision-corrected
estimate of similarity is not below the threshold by more than ESTIMATE_SLACK (four
standard errors) are verified on full sets and joined to components, which is enough
for most members of a large group. In buckets of any band that still hold several
components the members outside the
largest one ask all members of others, block by block: first each names the one of
the best estimate, then all whose estimate does not rule them out. What is named is
verified. A pair is named in the first band that its members share only, and no link
between different components is lost.

Defined cases: null text, or text without words, has an empty set, which is linked
with nothing; with fewer words than a shingle the whole text is one; rows without
doc_id are linked with nothing and kept; repeated rows are each returned, with one
class; the same doc_id with different texts is one node; of documents alike the
smallest doc_id names the class, also among equal sets; long texts are read whole and
have as many shingles as words; an empty table gives no rows; near_classes reads no
other columns, and keep_one_of_each passes them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.components import connected
from pagestrata.llm.tables import scratch, settle, small_side
from pagestrata.llm.words import GOLDEN, WordHasher, mix, shingles

BUCKETS, BUCKET_BITS = 512, 9
BANDS, ROWS = 32, 4
MANTISSA_BITS = 10
FILL = 8192
ESTIMATE_SLACK = 0.075
#: Bands in which members meet their bucket's hub before any others.
HUB_BANDS = 4
BLOCK = 2048
BROADCAST_IDS = 2_000_000
#: Expected share of registers that agree by chance, after Yu and Weber (fixed value).
CHANCE = 0.169919487159739 / 2**MANTISSA_BITS
SETS = "doc_id long, n long, k1 long, k2 long, level1 int, sketch1 binary, level2 int, sketch2 binary"
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("level1", pa.int32()), ("sketch1", pa.binary()), ("level2", pa.int32()), ("sketch2", pa.binary())])
NAMED = pa.schema([(c, pa.int64()) for c in ("key", "block", "asker", "doc")] + [("asked", pa.list_(pa.int64()))])
#: Hash values sketched at a time.
STEP = 1_000_000


def level_of(n: int) -> int:
    """log2 of how often each shingle is inserted."""
    return max(0, (FILL - 1) // n).bit_length() if n < FILL else 0


def sketch(sets: list[np.ndarray], level: int) -> np.ndarray:
    """(len(sets), BUCKETS) registers of sets on one level."""
    low = np.full(len(sets) * BUCKETS, np.uint64(2**64 - 1), np.uint64)
    copies = mix(np.arange(1, (1 << level) + 1, dtype=np.uint64) * GOLDEN)
    flat = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * BUCKETS, [len(s) for s in sets])
    rows = max(1, STEP >> level)
    for at in range(0, len(flat), rows):
        h = mix(flat[at : at + rows, None] + copies)
        bucket = base[at : at + rows, None] + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        np.minimum.at(low, bucket.ravel(), (h << np.uint64(BUCKET_BITS)).ravel())
    fraction, exponent = np.frexp(low.astype(float))
    zeros = np.clip(64 - exponent, 0, 62)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    return (zeros << MANTISSA_BITS | mantissa).astype("<u2").reshape(len(sets), BUCKETS)


def set_rows(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Per row of docs: its set's size, 128-bit key and sketches."""

    def make(batches):
        hasher = WordHasher()
        for batch in batches:
            texts = batch.column("text")
            for start in range(0, batch.num_rows, 1024):
                sets = [shingles(hasher(texts[i].as_py()), size) for i in range(start, min(batch.num_rows, start + 1024))]
                need: dict[int, list[tuple[int, int]]] = {}
                for i, s in enumerate(sets):
                    if len(s):
                        levels = dict.fromkeys((level_of(len(s)), level_of(int(len(s) / threshold) + 1)))
                        for which, level in enumerate(levels):
                            need.setdefault(level, []).append((i, which))
                levels_, sketches = np.full((2, len(sets)), -1), [[None] * len(sets), [None] * len(sets)]
                for level, wanted in need.items():
                    for (i, which), registers in zip(wanted, sketch([sets[i] for i, _ in wanted], level), strict=True):
                        levels_[which, i], sketches[which][i] = level, registers.tobytes()
                digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                halves = [np.frombuffer(d, "<i8").tolist() if d else (None, None) for d in digests]
                level = [pa.array([int(x) if x >= 0 else None for x in row], pa.int32()) for row in levels_]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([h[k] for h in halves], pa.int64()) for k in (0, 1)], level[0], pa.array(sketches[0], pa.binary()), level[1], pa.array(sketches[1], pa.binary())],
                    schema=SETS_ARROW,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, SETS)


def band_keys(level: int, registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a sketch's first BANDS * ROWS registers."""
    words = np.ascontiguousarray(registers[:, : BANDS * ROWS]).view("<u8")
    with np.errstate(over="ignore"):
        return mix(words * GOLDEN + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000 * (level + 1)))).view(np.int64)


def bands(reps: DataFrame) -> DataFrame:
    """(key, doc, band): the band buckets of representatives."""

    def make(batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for which in ("1", "2"):
                levels = batch.column(f"level{which}").to_pylist()
                sketches = batch.column(f"sketch{which}").to_pylist()
                for level in sorted({x for x in levels if x is not None}):
                    mine = [i for i, x in enumerate(levels) if x == level]
                    registers = np.frombuffer(b"".join(sketches[i] for i in mine), "<u2").reshape(len(mine), BUCKETS)
                    yield pa.RecordBatch.from_arrays([pa.array(band_keys(level, registers).ravel()), pa.array(np.repeat(docs[mine], BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(mine)))], names=["key", "doc", "band"])

    return reps.mapInArrow(make, "key long, doc long, band int")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, elements) with the full sets of docs."""

    def make(batches):
        hasher = WordHasher()
        for batch in batches:
            sets = [shingles(hasher(t.as_py()), size) for t in batch.column("text")]
            ends = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc", "elements"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, "doc long, elements array<long>")


def beside(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """pairs (a, b) with the other columns of data (doc, ...) as x of a and y of b; a frequent b is copied once per BLOCK of its pairs."""
    often = pairs.groupBy("b").agg((1 + F.floor(F.count("*") / BLOCK)).alias("parts")).where("parts > 1")
    whole = F.struct(*[c for c in data.columns if c != "doc"])
    left = pairs.join(data.select(F.col("doc").alias("a"), whole.alias("x")), "a").join(often, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))))
    right = data.select(F.col("doc").alias("b"), whole.alias("y")).join(often, "b", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.drop("parts").join(right, ["b", "part"]).drop("part")


def of_pairs(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """rows whose key is in a pair (a, b)."""
    wanted = settle(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct())
    return rows.join(small_side(wanted, wanted.count(), BROADCAST_IDS), rows[key] == wanted["_id"], "left_semi")


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose collision-corrected estimate of similarity does not rule them out."""

    def near(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = [[(batch.column(side).field(f"level{w}").to_pylist(), batch.column(side).field(f"sketch{w}").to_pylist()) for w in "12"] for side in "xy"]
            for i in range(batch.num_rows):
                x, y = ({levels[i]: registers[i] for levels, registers in side if levels[i] is not None} for side in sides)
                for level in x.keys() & y.keys():
                    agree = (np.frombuffer(x[level], "<u2") == np.frombuffer(y[level], "<u2")).mean()
                    keep[i] |= (agree - CHANCE) / (1 - CHANCE) >= threshold - ESTIMATE_SLACK
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return beside(pairs, of_pairs(reps, "doc", pairs)).select("a", "b", "x", "y").mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    sets = settle(full_sets(of_pairs(docs, "doc_id", pairs), size))
    common = F.size(F.array_intersect("x.elements", "y.elements")).cast("long")
    return beside(pairs, sets).where(100 * common >= percent * (F.size("x.elements") + F.size("y.elements") - common)).select("a", "b").distinct()


def labelled(nodes: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return nodes.withColumn("component", F.col("doc"))
    return nodes.join(components.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def open_buckets(rows: DataFrame) -> DataFrame:
    """(key, size, main, open) of the buckets of rows (key, doc, component) that hold several components.

    main is the component of most members, and open counts the others.
    """
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    found = parts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("b")).where("kinds > 1")
    return found.select("key", "size", F.col("b.component").alias("main"), (F.col("size") - F.col("b.n")).alias("open"))


def hub_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's hub, its least member."""
    hubs = bands.groupBy("key").agg(F.min("doc").alias("b"))
    return bands.join(hubs, "key").where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()


def open_pairs(bands: DataFrame, components: DataFrame | None, reps: DataFrame, threshold: float, best_only: bool) -> DataFrame:
    """Pairs of different components in one bucket.

    best_only: for each member that asks, its best pair in the bucket; else all pairs that the estimate does not rule out.
    A pair isn't a row of its own: rows (key, block, asker, doc, asked) list, for each member of a block, whom it asks.
    """
    members = settle(labelled(bands, components))
    found = open_buckets(members).select(F.col("key").alias("_key"), "main", (1 + F.floor(F.col("open") / BLOCK)).alias("askers"), (1 + F.floor(F.col("size") / BLOCK)).alias("blocks"))
    rows = settle(members.join(found, members["key"] == found["_key"]).drop("_key").withColumn("open", F.col("component") != F.col("main")))
    asked = settle(rows.select(F.col("doc").alias("_doc")).distinct())
    sketches = reps.join(small_side(asked, asked.count(), BROADCAST_IDS), reps["doc"] == asked["_doc"], "left_semi")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    rows = rows.withColumn("own_block", own("blocks")).withColumn("own_asker", own("askers"))
    # every member stays in its own block, once per part of the askers; those that ask also visit the other blocks
    stay = rows.withColumn("block", F.col("own_block")).withColumn("asker", each("askers")).withColumn("home", F.lit(True))
    ask = rows.where("open").withColumn("block", each("blocks")).where("block <> own_block").withColumn("asker", F.col("own_asker")).withColumn("home", F.lit(False))
    both = stay.unionByName(ask).withColumn("asks", F.col("open") & (F.col("asker") == F.col("own_asker")))
    dealt = both.select("key", "block", "asker", "doc", "component", "open", "asks", "home").join(sketches, "doc")

    def pick(group: pa.Table) -> pa.Table:
        asks, open_, home = (group[c].to_numpy(zero_copy_only=False) for c in ("asks", "open", "home"))
        doc, component = (group[c].to_numpy() for c in ("doc", "component"))
        key = group["key"][0].as_py()
        registers, band = np.zeros((len(doc), BUCKETS), "<u2"), np.full(len(doc), -1)
        for which in "12":
            levels, sketches = (group[f"{c}{which}"].to_pylist() for c in ("level", "sketch"))
            for i, (level, own) in enumerate(zip(levels, sketches, strict=True)):
                if own is not None and band[i] < 0:
                    one = np.frombuffer(own, "<u2")
                    at = np.flatnonzero(band_keys(level, one[None])[0] == key)
                    if len(at):
                        registers[i], band[i] = one, at[0]
        words = np.ascontiguousarray(registers[:, : BANDS * ROWS]).view("<u8")
        there = np.flatnonzero(home & (band >= 0))
        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(asks & (band >= 0)):
            rows = there[component[there] != component[i]]
            if not best_only:
                rows = rows[~open_[rows] | (doc[rows] < doc[i])]
            rows = rows[(words[rows] == words[i]).argmax(axis=1) == band[i]]
            agree = ((registers[rows] == registers[i]).mean(axis=1) - CHANCE) / (1 - CHANCE)
            near = agree >= threshold - ESTIMATE_SLACK
            if best_only and near.any():
                rows, near = rows[[agree.argmax()]], np.array([True])
            if near.any():
                found[int(doc[i])] = doc[rows[near]].tolist()
        # a row for every member that some pair needs, with those that it asks
        needed = sorted({*found, *(j for js in found.values() for j in js)})
        n = len(needed)
        return pa.table(
            [pa.array([group[c][0].as_py()] * n, pa.int64()) for c in ("key", "block", "asker")] + [pa.array(needed, pa.int64()), pa.array([found.get(d, []) for d in needed], pa.list_(pa.int64()))],
            schema=NAMED,
        )

    return dealt.groupBy("key", "block", "asker").applyInArrow(pick, "key long, block long, asker long, doc long, asked array<long>")


def links_of(named: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the named pairs whose full sets pass, compared where the members of a block meet."""
    wanted = settle(named.select(F.col("doc").alias("_id")).distinct())
    rows = docs.join(small_side(wanted, wanted.count(), BROADCAST_IDS), docs["doc_id"] == wanted["_id"], "left_semi")
    sets = settle(full_sets(rows, size)).dropDuplicates(["doc", "elements"])

    def compare(group: pa.Table) -> pa.Table:
        elements: dict[int, list[np.ndarray]] = {}
        for d, e in zip(group["doc"].to_pylist(), group["elements"], strict=True):
            elements.setdefault(d, []).append(np.sort(e.values.to_numpy()))
        asked = dict(zip(group["doc"].to_pylist(), group["asked"].to_pylist(), strict=True))
        found = set()
        for d, others in asked.items():
            for x in elements[d]:
                for other in others:
                    for y in elements[other]:
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            found.add((max(d, other), min(d, other)))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return named.join(sets, "doc").groupBy("key", "block", "asker").applyInArrow(compare, "a long, b long").distinct()


def near_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    with scratch(docs.sparkSession) as keep:
        return keep(_near_classes(docs, size, percent))


def _near_classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    spark, threshold = docs.sparkSession, percent / 100
    with scratch(spark) as keep:
        rows = keep(set_rows(docs, size, threshold).withColumn("row", F.monotonically_increasing_id()))
        classes = rows.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("copies"))
        dupes = keep(classes.where("copies > 1").select("k1", "k2", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("first")))
        copied = dupes.count()
        every = rows.join(small_side(dupes, copied, BROADCAST_IDS), ["k1", "k2"], "left").withColumn("doc", F.coalesce("doc", "doc_id"))
        reps = every.where("k1 is not null and doc_id is not null and coalesce(first, row) = row").select("doc", "level1", "sketch1", "level2", "sketch2")
        # sketches are most of what is stored: a broadcast finds them again without a second copy
        reps = reps if copied <= BROADCAST_IDS else keep(reps)
        marked = keep(every.select("doc_id", F.col("n").alias("n_shingles"), "doc"))
    with scratch(spark) as keep:
        all_bands = settle(bands(reps))
        shared = all_bands.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
        shared = settle(shared)
        buckets = keep(all_bands.join(small_side(shared, shared.count(), BROADCAST_IDS), "key", "left_semi"))
    components = None

    def add(links: DataFrame) -> None:
        nonlocal components
        if links.head(1):
            # what is linked already comes in as stars, which need few rounds
            known = links.limit(0) if components is None else components.select(F.col("node").alias("a"), F.col("component").alias("b"))
            with scratch(spark) as keep:
                components = keep(connected(links.unionByName(known)))

    with scratch(spark) as keep:
        pairs = settle(hub_pairs(buckets.where(F.col("band") < HUB_BANDS).drop("band")))
        links = keep(verified(settle(estimated(pairs, reps, threshold)), docs, size, percent))
    add(links)
    for best_only in (True, False):
        with scratch(spark) as keep:
            named = settle(open_pairs(buckets.drop("band"), components, reps, threshold, best_only))
            new = keep(links_of(named, docs, size, percent)) if named.head(1) else None
        if new is not None:
            add(new)
    if components is None:
        components = spark.createDataFrame([], "node long, component long")
    found = marked.join(components.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component_id", F.coalesce("component", "doc"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: the smallest doc_id of each class stays."""
    out = settle(near_classes(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(small_side(out, out.count(), BROADCAST_IDS), docs["doc_id"] == out["_id"], "left_anti")
