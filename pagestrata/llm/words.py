"""Words and stable 64-bit hashes of them, for work on batches inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the 64-bit finaliser (fixed values).
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """Hashes of ASCII-lower-cased words between ASCII white space; known words are looked up."""

    def __init__(self, known: int = 1_000_000):
        self.seen: dict[bytes, int] = {}
        self.known = known

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        seen = self.seen
        try:
            found = [seen[w] for w in words]
        except KeyError:
            if len(seen) > self.known:
                seen.clear()
            digest = xxhash.xxh64_intdigest
            for w in words:
                if w not in seen:
                    seen[w] = digest(w)
            found = [seen[w] for w in words]
        return np.array(found, dtype=np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of size words; fewer words count as one run, none give none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    span = min(n, size)
    with np.errstate(over="ignore"):
        h = np.full(n - span + 1, np.uint64(span), np.uint64)
        for k in range(span):
            h = mix(h * GOLDEN + words[k : n - span + 1 + k])
    return np.unique(h)
