"""Packing token sequences by best-fit decreasing.

Every document is encoded once, in batches inside the tasks; only the lengths and
checksums of its pieces travel on. A document over the window is cut into full
windows, which need no search, and one rest. Rests are dealt to shards of about
PIECES_PER_SHARD of them and packed there, longest first, into the tightest open
window, which a segment tree over remaining capacities finds in logarithmic time.
Full windows have shards of their own, counted alike, so no shard grows with the input.

Ids come from the rank file of the byte-level vocabulary, which gives the ids of
the JSON file of the same vocabulary (tests compare both) at a third of the cost,
and for long texts from the JSON file itself (llm/encoding.py); a .json path is read
by the tokenizers library throughout.

Defined cases: null text is empty, an empty document is its end id alone; rows
without doc_id are packed like others; repeated rows are packed each; pieces of equal
length are placed in order of doc_id, start and checksum; long texts are cut into
as many windows as they fill; an empty table gives no pieces; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.encoding import encoder, vocabulary
from pagestrata.llm.tables import settle

WINDOW = 2048
END_ID = 1
PIECES_PER_SHARD = 4096
#: Characters encoded at a time in a task.
BATCH_CHARS = 2_000_000
PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list]]:
    """(doc_ids, ids with the end id) in runs of about BATCH_CHARS."""
    encode = encoder(path, special=True)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(ids):
            run, chars = [], 0
            while at + len(run) < len(ids) and chars < BATCH_CHARS:
                run.append(texts[at + len(run)].as_py() or "")
                chars += len(run[-1])
            yield ids[at : at + len(run)], [np.array([*x, END_ID], "<u4") for x in encode(run)]
            at += len(run)


def pieces_of(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows, then the rest of each document."""

    def cut(batches):
        for docs_, ids_ in encoded(batches, path):
            rows = [
                (doc, start, min(window, len(ids) - start), zlib.crc32(ids[start : start + window].tobytes()), len(ids))
                for doc, ids in zip(docs_, ids_, strict=True)
                for start in range(0, len(ids), window)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, schema=PIECE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


class OpenWindows:
    """How many open windows have each remaining capacity, as a segment tree of sums."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity of at least need, and that capacity."""
        at = need + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, packed longest first."""
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if need == window or (found := tree.take(need)) is None:
            found, opened = (opened, window), opened + 1
        which[i], room = found
        offset[i] = window - room
        if room > need:
            tree.put(room - need, found[0])
    return which, offset


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece with its sequence and offset; sequence_id is shard * 2**32 + number in the shard."""
    pieces = settle(pieces_of(docs, path or vocabulary("byte_bpe_50k.tiktoken"), window))
    n = pieces.agg(F.count_if(F.col("length") == window).alias("full"), F.count_if(F.col("length") < window).alias("rest")).first()
    shards, more = (1 + n[c] // PIECES_PER_SHARD for c in ("rest", "full"))

    def place(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        which, offset = best_fit(shard["length"].to_numpy(), window)
        ids = which + (shard["_shard"][0].as_py() << 32)
        return shard.drop(["_shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    # dealt by row, so that repeated rows are not one shard
    row = F.xxhash64(F.monotonically_increasing_id())
    dealt = pieces.withColumn("_shard", F.when(F.col("length") < window, F.pmod(row, F.lit(shards))).otherwise(shards + F.pmod(row, F.lit(more))))
    return dealt.groupBy("_shard").applyInArrow(place, PLACED)
