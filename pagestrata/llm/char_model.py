"""Interpolated Kneser-Ney models over characters, held in sorted hash arrays.

An n-gram of four characters is one unsigned 64-bit key, 16 bits a character, so
keys of contexts and of shorter n-grams are shifts and masks of it. Orders 1 to 3
use continuation counts, which follow from the distinct n-grams of the order above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ORDER = 4
BITS = np.uint64(16)
#: Characters counted or scored at a time in a task.
CHUNK = 1_000_000
SPACE = 32


def letters() -> np.ndarray:
    """Whether each 16-bit unit is a letter; units over U+FFFF are folded onto U+FFFF, which counts as one."""
    table = np.zeros(1 << 16, bool)
    table[[i for i in range(1 << 16) if not 0xD800 <= i <= 0xDFFF and chr(i).isalpha()]] = True
    table[0xFFFF] = True
    return table


def units(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF).astype(np.uint64)


def keys(parts: list[np.ndarray]) -> np.ndarray:
    """The order-4 key that ends at each character; before a text stand spaces."""
    sizes = np.array([len(p) for p in parts])
    if not sizes.sum():
        return np.empty(0, np.uint64)
    chars = np.concatenate(parts)
    at = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = chars.copy()
    for back in range(1, ORDER):
        before = np.full(len(chars), SPACE, np.uint64)
        before[back:] = chars[:-back]
        before[at < back] = SPACE
        out |= before << (BITS * np.uint64(back))
    return out


def chunks(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(indices, keys, lengths) in runs of about CHUNK characters; a longer text comes in several runs, each with its left context."""
    held: list[tuple[int, np.ndarray, int]] = []

    def flush():
        got = keys([p for _, p, _ in held])
        sizes = np.array([len(p) for _, p, _ in held])
        skip = np.array([s for _, _, s in held])
        if skip.any():
            at = np.arange(len(got)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            got = got[at >= np.repeat(skip, sizes)]
        return [i for i, _, _ in held], got, sizes - skip

    size = 0
    for i, part in parts:
        for at in range(0, max(1, len(part)), CHUNK):
            skip = min(at, ORDER - 1)
            held.append((i, part[at - skip : at + CHUNK], skip))
            size += len(held[-1][1])
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, n = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def look_up(k: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at wanted keys, 0 where absent."""
    if not len(k):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(k, wanted), len(k) - 1)
    return np.where(k[at] == wanted, values[at], 0)


class KneserNey:
    """One interpolated Kneser-Ney model; discounts are n1 / (n1 + 2 n2) per order."""

    def __init__(self, k: np.ndarray, n: np.ndarray, vocabulary: int):
        self.vocabulary, self.levels = vocabulary, []
        counts = n.astype(float)
        for order in range(ORDER, 0, -1):
            n1, n2 = float((counts == 1).sum()), float((counts == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context = k >> BITS
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(k) else np.empty(0, np.int64)
            total = np.add.reduceat(counts, first) if len(k) else counts
            kinds = np.diff(np.r_[first, len(k)]) if len(k) else counts
            self.levels.append((order, k, counts, discount, context[first], total, kinds.astype(float)))
            k, counts = merged([(k & np.uint64((1 << 16 * (order - 1)) - 1), np.ones(len(k), np.int64))])
            counts = counts.astype(float)

    def probability(self, wanted: np.ndarray) -> np.ndarray:
        p = np.full(len(wanted), 1.0 / self.vocabulary)
        for order, k, counts, discount, contexts, total, kinds in reversed(self.levels):
            key = wanted & np.uint64((1 << 16 * order) - 1) if order < ORDER else wanted
            context = key >> BITS
            all_, types = look_up(contexts, total, context), look_up(contexts, kinds, context)
            seen = np.maximum(look_up(k, counts, key) - discount, 0)
            p = np.where(all_ > 0, (seen + discount * types * p) / np.maximum(all_, 1), p)
        return p


class Scorer:
    """Summed -log2 p of texts under several models; answers for keys are kept for the next batch."""

    def __init__(self, answer, width: int, keep: int = 2_000_000):
        self.answer, self.width, self.keep = answer, width, keep
        self.k, self.v = np.empty(0, np.uint64), np.empty((0, width))

    def values(self, k: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(k, return_inverse=True)
        if len(self.k):
            near = np.minimum(np.searchsorted(self.k, distinct), len(self.k) - 1)
            new = distinct[self.k[near] != distinct]
        else:
            new = distinct
        if len(new):
            if len(self.k) + len(new) > self.keep:
                self.k, self.v, new = distinct[:0], self.v[:0], distinct
            k_, v_ = np.concatenate([self.k, new]), np.concatenate([self.v, self.answer(new)])
            order = np.argsort(k_)
            self.k, self.v = k_[order], v_[order]
        return self.v[np.searchsorted(self.k, distinct)][at]

    def sums(self, parts: Iterator[tuple[int, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
        total, length = np.zeros((rows, self.width)), np.zeros(rows, np.int64)
        for which, k, sizes in chunks(parts):
            if not len(k):
                continue
            v = self.values(k)
            some = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[some]
            np.add.at(total, np.array(which)[some], np.add.reduceat(v, starts, axis=0))
            np.add.at(length, which, sizes)
        return total, length
