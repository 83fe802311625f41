"""Fuzzy substring dedup by collinear chaining.

Seeds are minimizers: of every WINDOW successive runs of K words, the one with the
least hash; a seed that occurs again in its document is also one with its ordinal.
Each seed's first occurrence (smallest document, then position) is its
anchor, and every other document's occurrence is one match with that anchor, so a
seed that very many documents share makes as many matches as it has occurrences,
never pairs. Matches of a document with one anchor document are chained: in order of
position, a match follows the earlier one on both sides with the best score less gap
costs (GAP_COST a word on either side), found as a prefix maximum in a Fenwick tree
over the anchors' positions. Chains are cut where either side skips more than BRIDGE
words, and aligned on the words themselves: stretches between seeds by edit
distance, ends by extension over substitutions, insertions and deletions until DROP is
lost against the best place. A chain of
which less than MIN_EQUAL is equal (MIN_EQUAL_SCATTERED, if edits are scattered) is cut at its most unequal stretch, and so are
its parts, until each is equal enough or too short. Spans of one document that
touch, whatever their anchors, are merged; merged spans of MIN_WORDS words are
repeated passages.

Defined cases: null or empty texts and texts shorter than K words have no seeds and
no passages, and an empty table has none; rows without doc_id take no part; repeated
rows of one doc_id are one document, and repeats inside a document alone aren't
reported; the first document that has a passage (ties: the smallest doc_id) is
reported as a source only; long texts are read whole, and only their seeds and
matches travel; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.tables import settle, small_side
from pagestrata.llm.words import GOLDEN, WordHasher, mix

K, WINDOW_RUNS = 5, 8
GAP_COST = 0.05
MIN_SEEDS = 2
MIN_EQUAL = 0.8
#: Enough where no stretch between seeds has more unequal words than this.
MIN_EQUAL_SCATTERED, SCATTERED = 0.75, 12
MIN_WORDS = 40
MIN_PART = 16
EDIT_COST, DROP, SHIFT = 2.0, 8.0, 8
#: Chains are cut at stretches of more words than this.
BRIDGE = 128
#: Words beside a chain that its ends may extend over.
REACH = 128
BROADCAST_IDS = 4_000_000


def minimizers(words: np.ndarray, k: int = K, window: int = WINDOW_RUNS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the minimizers of a sequence of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k), np.uint64)
        for i in range(k):
            h = mix(h * GOLDEN + words[i : n + i])
    view = np.lib.stride_tricks.sliding_window_view(h, min(window, n))
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    h = h[at]
    # of equal seeds that follow closely, as in one word over and over, one per window stays
    fresh = np.r_[True, (h[1:] != h[:-1]) | (np.diff(at) >= window)]
    stays = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % window == 0
    h, at = h[stays], at[stays]
    # a seed's second and later occurrences are also seeds of their own, so that repetitive passages chain
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    again = nth > 0
    with np.errstate(over="ignore"):
        own = mix(h[order][again] + nth[again].astype(np.uint64) * GOLDEN)
    return np.concatenate([h, own]), np.concatenate([at, at[order][again]])


def seed_rows(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, at) of every document."""

    def make(batches):
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            found = [minimizers(hasher(t.as_py())) for t in batch.column("text")]
            n = [len(h) for h, _ in found]
            if sum(n):
                h, at = (np.concatenate([x[i] for x in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(ids, n)), pa.array(at.astype(np.int32))], names=["seed", "doc_id", "at"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "seed long, doc_id long, at int")


def matches(seeds: DataFrame) -> DataFrame:
    """(doc_id, source, hits): the matches of each document with each anchor document, in order of position."""
    first = (
        seeds.groupBy("seed")
        .agg(F.min(F.struct("doc_id", "at")).alias("a"), F.max("doc_id").alias("last"))
        .where("a.doc_id < last")
        .select("seed", F.col("a.doc_id").alias("source"), F.col("a.at").alias("source_at"))
    )
    hits = seeds.join(first, "seed").where("doc_id <> source")
    listed = hits.groupBy("doc_id", "source").agg(F.collect_list(F.struct("at", "source_at")).alias("hits"))
    return listed.where(F.size("hits") >= MIN_SEEDS).withColumn("hits", F.array_sort("hits"))


class Fenwick:
    """Prefix maxima of (value, which) over places 1 to n."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        while at < len(self.best):
            self.best[at] = max(self.best[at], value)
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        found = self.best[0]
        while at:
            found = max(found, self.best[at])
            at -= at & -at
        return found


def scores(hits: list[tuple[int, int]], k: int = K) -> tuple[list[float], list[int]]:
    """Best score of a chain that ends at each of the sorted hits, and the match before it (-1: none).

    A match adds k, and costs GAP_COST for each word from the match before on either side.
    """
    places = {b: i for i, b in enumerate(sorted({b for _, b in hits}), 1)}
    tree, score, link = Fenwick(len(places)), [float(k)] * len(hits), [-1] * len(hits)
    at = 0
    while at < len(hits):
        run = at
        while run < len(hits) and hits[run][0] == hits[at][0]:
            a, b = hits[run]
            before, which = tree.upto(places[b] - 1)
            if before - GAP_COST * (a + b) > 0:
                score[run], link[run] = k + before - GAP_COST * (a + b), which
            run += 1
        for i in range(at, run):
            tree.put(places[hits[i][1]], (score[i] + GAP_COST * sum(hits[i]), i))
        at = run
    return score, link


def chain(hits: list[tuple[int, int]], k: int = K) -> list[list[tuple[int, int]]]:
    """Disjoint chains of MIN_SEEDS matches or more, best first; a chain is cut where either side skips more than BRIDGE words."""
    hits = sorted(set(hits))
    score, link = scores(hits, k)
    used, out = [False] * len(hits), []
    for end in sorted(range(len(hits)), key=lambda x: -score[x]):
        path: list[tuple[int, int]] = []
        while end >= 0 and not used[end]:
            used[end] = True
            if path and max(path[-1][0] - hits[end][0], path[-1][1] - hits[end][1]) > BRIDGE:
                out.append(path[::-1])
                path = []
            path.append(hits[end])
            end = link[end]
        out.append(path[::-1])
    return [path for path in out if len(path) >= MIN_SEEDS]


def edits(x: np.ndarray, y: np.ndarray) -> int:
    """Edit distance of two short word sequences."""
    if not len(x) or not len(y):
        return max(len(x), len(y))
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        nxt = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(np.r_[i, nxt] - steps) + steps
    return int(row[-1])


def extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How far x runs together with y, and the edits on the way, until DROP is lost against the best place.

    A word on both sides counts 1, an edit costs EDIT_COST; for each number of edits the
    furthest place of every diagonal is kept (x - y, within SHIFT), as only it can lead to the best place.
    """
    x, y = x.tolist(), y.tolist()
    n, m = len(x), len(y)
    best, found, edits_ = 0.0, 0, 0
    at = {0: 0}
    for d in range(n + m + 1):
        # slide along each diagonal while words agree
        for k, i in at.items():
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            at[k] = i
        score = {k: i - k / 2 - EDIT_COST * d for k, i in at.items()}
        k = max(score, key=score.get, default=None)
        if k is not None and score[k] > best:
            best, found, edits_ = score[k], at[k], d
        at = {k: i for k, i in at.items() if score[k] > best - DROP}
        if not at:
            break
        more: dict[int, int] = {}
        for k, i in at.items():
            for to, place in ((k, i + 1), (k + 1, i + 1), (k - 1, i)):
                if abs(to) <= SHIFT and place <= n and place - to <= m and place > more.get(to, -1):
                    more[to] = place
        at = more
    return found, edits_


def align(x: np.ndarray, y: np.ndarray, path: list[tuple[int, int]], k: int = K) -> list[tuple[int, int]]:
    """(start, end) in x of the passages that a chain stands for: all of it, or the parts that its most unequal stretches leave."""
    unequal = [0]
    for (a, b), (next_a, next_b) in zip(path, path[1:], strict=False):
        gap_a, gap_b = x[a + k : next_a], y[b + k : next_b]
        if next_a >= a + k and next_b >= b + k:
            n = int((gap_a != gap_b).sum()) if len(gap_a) == len(gap_b) else len(gap_a) + len(gap_b)
            n = n if n <= 2 else min(n, edits(gap_a, gap_b))
        else:
            n = abs((next_a - a) - (next_b - b))
        unequal.append(n)
    upto = np.cumsum(unequal)
    out, parts = [], [(0, len(path) - 1)]
    while parts:
        i, j = parts.pop()
        (a, b), (end_a, end_b) = path[i], (path[j][0] + k, path[j][1] + k)
        # a part reaches no further than the parts beside it
        low_a, low_b = (path[i - 1][0] + k, path[i - 1][1] + k) if i else (0, 0)
        high_a, high_b = path[j + 1] if j + 1 < len(path) else (len(x), len(y))
        before, after = (x[low_a:a][::-1], y[low_b:b][::-1]), (x[end_a:high_a], y[end_b:high_b])
        (left, n_left), (right, n_right) = extend(*before), extend(*after)
        start, end = a - left, end_a + right
        n = int(upto[j] - upto[i]) + n_left + n_right
        if end - start < MIN_PART:
            continue
        scattered = max(unequal[i + 1 : j + 1], default=0) <= SCATTERED
        if n <= (1 - (MIN_EQUAL_SCATTERED if scattered else MIN_EQUAL)) * (end - start):
            out.append((start, end))
        elif i < j:
            cut = i + int(np.argmax(unequal[i + 1 : j + 1]))
            parts += [(i, cut), (cut + 1, j)]
    return out


def chained(pairs: DataFrame) -> DataFrame:
    """(doc_id, source, path): one row per chain."""
    path = pa.list_(pa.struct([("at", pa.int32()), ("source_at", pa.int32())]))

    def make(batches):
        for batch in batches:
            ids, sources = batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()
            rows = []
            for i, hits in enumerate(batch.column("hits")):
                flat = hits.values
                pairs_ = list(zip(flat.field("at").to_pylist(), flat.field("source_at").to_pylist(), strict=True))
                rows += [(ids[i], sources[i], [{"at": a, "source_at": b} for a, b in c]) for c in chain(pairs_)]
            if rows:
                d, s, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(p, path)], names=["doc_id", "source", "path"])

    return pairs.mapInArrow(make, "doc_id long, source long, path array<struct<at:int,source_at:int>>")


def word_rows(docs: DataFrame) -> DataFrame:
    """(id, words): 32-bit hashes of a document's words, for alignment."""

    def make(batches):
        hasher = WordHasher()
        for batch in batches:
            words = [(hasher(t.as_py()) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in batch.column("text")]
            ends = np.cumsum([0, *[len(w) for w in words]]).astype(np.int32)
            flat = np.concatenate(words) if words else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "id long, words array<int>")


def aligned(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, source, start, end): the aligned passages of each chain, in words of doc_id."""
    wanted = settle(chains.select(F.col("doc_id").alias("_id")).union(chains.select("source")).distinct())
    words = settle(word_rows(docs.join(small_side(wanted, wanted.count(), BROADCAST_IDS), docs["doc_id"] == wanted["_id"], "left_semi")))

    def cut(which: str):
        ends = F.transform("path", lambda p: p[which])
        low = F.greatest(F.array_min(ends) - REACH, F.lit(0))
        return low, F.array_max(ends) + K + REACH - low

    for key, which, name in (("doc_id", "at", "x"), ("source", "source_at", "y")):
        low, n = cut(which)
        chains = chains.join(words.withColumnsRenamed({"id": key}), key).withColumn(f"{name}_low", low).withColumn(name, F.slice("words", low + 1, n)).drop("words")

    def make(batches):
        for batch in batches:
            rows = []
            columns = {c: batch.column(c) for c in ("doc_id", "source", "x_low", "y_low")}
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in "xy")
                doc, source, x_low, y_low = (columns[c][i].as_py() for c in columns)
                path = batch.column("path")[i].values
                hits = list(zip((path.field("at").to_numpy() - x_low).tolist(), (path.field("source_at").to_numpy() - y_low).tolist(), strict=True))
                rows += [(doc, source, start + x_low, end + x_low) for start, end in align(x, y, hits)]
            if rows:
                d, s, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "source", "start", "end"])

    return chains.mapInArrow(make, "doc_id long, source long, start int, end int")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, sources): passages that occur in an earlier document too."""
    chains = settle(chained(matches(settle(seed_rows(docs)))))
    spans = aligned(chains, docs).groupBy("doc_id", "start", "end").agg(F.collect_set("source").alias("sources"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("fresh", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    merged = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return merged.withColumn("n_words", F.col("end_word") - F.col("start_word")).where(F.col("n_words") >= min_words).select("doc_id", "start_word", "end_word", "n_words", "sources")
