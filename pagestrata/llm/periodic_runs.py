"""Runs of repeating words by an enhanced suffix array, without tree nodes.

The words of a block of documents are one sequence of numbers, ranked by document first,
so that suffixes of different documents never share a prefix. Prefix doubling sorts the
suffixes; only those that aren't alone yet are sorted again, and the ranks of each
doubling are kept. From them come the longest common prefixes of neighbours in the array.

Each LCP interval stands for an inner node of the suffix tree: its depth is the least LCP
inside, its children lie between the places where the LCP is that depth. Of every interval
all children but the largest are read: for a suffix i of such a child the test of branching
tandem repeats asks whether i + depth and i - depth lie in the interval (by the inverse
array) but in another child. Then a square with root length depth starts at i or i - depth,
and the next word breaks it. A square is rotated to the left while the words agree, by the
kept ranks in halving steps, and squares that reach the same stretch are merged into one run
with the smallest period.

A stretch of words with period p that no neighbour extends ends in exactly one such square
of root p, so every run of two periods or more is found; MIN_WORDS and MIN_EXPONENT say
which are reported.

All steps are array operations over blocks of about BLOCK_WORDS words inside a task; nothing
is shuffled. Memory grows with the words of a block times the doublings that its longest
repeat takes.

Defined cases: null and empty texts have no words and no runs; a text over BLOCK_WORDS is a
block of its own, read whole; equally good runs are all reported, in order of start, then
period; rows without doc_id and repeated rows are read like others; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 6
MIN_EXPONENT = 4
BLOCK_WORDS = 1 << 18
#: Suffixes of small children that are tested at a time.
TESTED = 1 << 21
RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.binary())])


def suffix_array(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffixes in order, LCP of each with the one before, ranks by the first 1, 2, 4, ... words).

    codes: numbers of words; doc: the number of each word's document; ends: where it ends.
    """
    n = len(codes)
    key = doc * (int(codes.max(initial=0)) + 1) + codes
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    fresh = np.r_[True, key[1:] != key[:-1]]
    place = np.arange(n)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(fresh, place, 0))
    levels, lcp, h = [rank], np.zeros(n, np.int64), 1
    open_ = place[~(fresh & np.r_[fresh[1:], True])]
    while len(open_):
        i = sa[open_]
        next_ = i + h
        second = np.where(next_ < ends[i], rank[np.minimum(next_, n - 1)], -1)
        group = rank[i].astype(np.int64)
        key = group * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        i, key, group = i[order], key[order], group[order]
        sa[open_] = i
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[i] = np.maximum.accumulate(np.where(fresh, open_, 0))
        split = np.flatnonzero(fresh[1:] & (group[1:] == group[:-1])) + 1
        lcp[open_[split]] = _agreement(i[split - 1], i[split], ends[i[split]], levels, h)
        levels.append(rank)
        open_ = open_[~(fresh & np.r_[fresh[1:], True])]
        h *= 2
    return sa, lcp, levels


def _agreement(i: np.ndarray, j: np.ndarray, end: np.ndarray, levels: list[np.ndarray], h: int) -> np.ndarray:
    """How many words suffixes i and j share, given that they share h, but not 2 h; levels reach to h."""
    n = np.full(len(i), h)
    last = len(levels[0]) - 1
    for rank in levels[-2::-1]:
        h //= 2
        a, b = i + n, j + n
        inside = np.maximum(a, b) < end
        n += h * (inside & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]))
    return n


def _nearest(values: np.ndarray, at: np.ndarray, start: np.ndarray, strict: bool) -> np.ndarray:
    """For places at, the nearest earlier place with a smaller value (strict), or one not greater; start[p]: where the search of p begins, with nothing such between."""
    to = start.copy()
    while len(at):
        here = to[at]
        over = values[here] >= values[at] if strict else values[here] > values[at]
        at = at[over]
        to[at] = to[here[over]]
    return to


def small_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(depth, left, right, first, last): every child but the largest of each LCP interval, with the interval's depth and bounds."""
    n = len(lcp)
    at = np.flatnonzero(lcp)
    if not len(at):
        return (at,) * 5
    # one place more at either end of the reversed copy, as the next smaller value may be beyond the last
    back = np.r_[0, lcp[::-1]]
    back_at = n - at[::-1]
    begin, back_begin = np.maximum(np.arange(n) - 1, 0), np.maximum(np.arange(n + 1) - 1, 0)
    child = _nearest(lcp, at, begin, False)
    left = _nearest(lcp, at, child, True)[at]
    back_child = _nearest(back, back_at, back_begin, False)
    right = (n - _nearest(back, back_at, back_child, True)[back_at])[::-1] - 1
    after = (n - back_child[back_at])[::-1]
    depth = lcp[at]
    ends_here = np.r_[lcp, 0][after] < depth
    first = np.r_[child[at], at[ends_here]]
    last = np.r_[at - 1, right[ends_here]]
    depth, left, right = (np.r_[x, x[ends_here]] for x in (depth, left, right))
    order = np.lexsort((first - last, right, left))
    same = (left[order][1:] == left[order][:-1]) & (right[order][1:] == right[order][:-1])
    small = order[1:][same]
    return depth[small], left[small], right[small], first[small], last[small]


def branching_squares(sa: np.ndarray, lcp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of every square that the next word, or the document's end, breaks."""
    isa = np.empty(len(sa), np.int64)
    isa[sa] = np.arange(len(sa))
    children = small_children(lcp)
    upto = np.cumsum(children[4] - children[3] + 1)
    found = []
    at = 0
    while at < len(upto):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + TESTED, "right")))
        depth, left, right, first, last = (x[at:to] for x in children)
        size = last - first + 1
        which = np.repeat(np.arange(len(size)), size)
        i = sa[np.arange(len(which)) + np.repeat(first - (np.cumsum(size) - size), size)]
        d = depth[which]
        for j, start in ((i + d, i), (i - d, i - d)):
            inside = np.flatnonzero((j >= starts[i]) & (j < ends[i]))
            c, p = which[inside], isa[j[inside]]
            hit = inside[(p >= left[c]) & (p <= right[c]) & ((p < first[c]) | (p > last[c]))]
            found.append((start[hit], d[hit]))
        at = to
    return tuple(np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def runs(codes: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, period) of the runs in documents bounds[k] to bounds[k + 1], in this order."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(codes):
        return (np.empty(0, np.int64),) * 4
    starts, ends = bounds[doc], bounds[doc + 1]
    sa, lcp, levels = suffix_array(codes, doc, ends)
    square, period = branching_squares(sa, lcp, starts, ends)
    # rotate to the left: how many words before a square agree with those one period later
    turned = np.zeros(len(square), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = square - turned - (1 << k)
        ok = at >= starts[square]
        turned += (ok & (levels[k][np.maximum(at, 0)] == levels[k][np.maximum(at, 0) + period])) << k
    start, end = square - turned, square + 2 * period
    enough = end - start >= np.maximum(min_words, min_exponent * period)
    start, end, period = start[enough], end[enough], period[enough]
    # one stretch that is found with multiples of its period too is one run
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return doc[start], start - starts[start], end - start, period


def block_rows(ids: list, texts: list[list[bytes]], min_words: int, min_exponent: int) -> pa.RecordBatch:
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.r_[0, np.cumsum(sizes)]
    codes = np.fromiter((number[w] for t in texts for w in t), np.int64, int(bounds[-1]))
    doc, start, length, period = runs(codes, bounds, min_words, min_exponent)
    # words after the first period of a run
    drops = np.zeros(len(codes) + 1, np.int64)
    np.add.at(drops, bounds[doc] + start + period, 1)
    np.add.at(drops, bounds[doc] + start + length, -1)
    stays = np.cumsum(drops)[:-1] == 0
    collapsed = [b" ".join(t) for t in texts]
    for k in np.unique(doc).tolist():
        collapsed[k] = b" ".join([w for w, s in zip(texts[k], stays[bounds[k] : bounds[k + 1]].tolist(), strict=True) if s])
    offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(ids)))].astype(np.int32)
    listed = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(RUN))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), listed, type=pa.list_(RUN)), pa.array(collapsed, pa.binary())], schema=FOUND)


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs.

    runs: (start, length, period) in words; collapsed: the words that stay when every run
    keeps its first period only, joined by spaces.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or b"").split()
                if ids and size + len(words) > BLOCK_WORDS:
                    yield block_rows(ids, texts, min_words, min_exponent)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if ids:
                yield block_rows(ids, texts, min_words, min_exponent)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(make, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def best_run(runs_: Column) -> Column:
    """The run with the greatest length/period, compared exactly; the first one of ties, as runs are in order of start, then period; null without runs."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs_, F.get(runs_, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
