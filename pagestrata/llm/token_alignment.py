"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

Every text is encoded by a byte-level vocabulary (A, with a space before the text) and by a
vocabulary of pieces (B, which adds that space itself). Tokens and bytes make incidence
matrices in compressed rows: a token's row holds its bytes. A row product (Gustavson: each
entry of a row of the left matrix adds a row of the right one) of A with the transpose of B
has an entry for each A token and B token that share bytes, valued by how many: the overlap
links. Places where a token of A and a token of B both end cut a text into groups; the
product of the tokens' group incidences links all tokens of a group.

Rows of documents are stacked, so a matrix is block-diagonal, and cut at ends of groups to
about STRETCH bytes; a group longer than that is one stretch. Group links are as many as
the product of a group's sizes; they are made by linked_tokens(by="groups") in stretches of
rows, and no query needs them all.

How many documents hold a pair of ids linked is counted over the whole corpus: each
document's distinct pairs and their numbers are written once, pairs are counted with partial
sums, and the counts meet the documents' pairs in a join. The counts, at most one a pair of
the vocabularies, are broadcast up to BROADCAST_PAIRS of them; beyond, Spark joins by
shuffle and splits skewed pairs.

A's ids come from the rank file of the same vocabulary (tests hold them equal to the JSON
file's), as the JSON reader takes 3.5 times as long; see llm/encoding.py.

Defined cases: null and empty texts, and texts whose tokens' bytes aren't the space and the
text (a piece vocabulary may normalise), have no tokens: zeros and empty groups; strings of
special tokens are plain text; long texts are encoded whole; rows without doc_id and repeated
rows are documents like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.encoding import byte_tokens, encoder, vocabulary
from pagestrata.llm.tables import scratch, settle, small_side

#: Characters encoded at a time, bytes and entries multiplied at a time.
BLOCK_CHARS = 400_000
STRETCH = 1 << 20
#: A pair is A's id times this plus B's id.
PAIR_BASE = 1 << 15
BROADCAST_PAIRS = 3_000_000


class Csr(NamedTuple):
    """The places of a matrix' entries by compressed rows; all entries are 1."""

    starts: np.ndarray
    columns: np.ndarray


class Links(NamedTuple):
    """The entries of a product: row, column and value, in order of row."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray


def incidence(sizes: np.ndarray) -> Csr:
    """Rows that hold the next sizes[k] columns each, as tokens hold bytes."""
    starts = np.r_[0, np.cumsum(sizes)]
    return Csr(starts, np.arange(starts[-1]))


def transposed(m: Csr, columns: int) -> Csr:
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    order = np.argsort(m.columns, kind="stable") if (np.diff(m.columns) < 0).any() else slice(None)
    return Csr(np.r_[0, np.cumsum(np.bincount(m.columns, minlength=columns))], rows[order])


def product(left: Csr, right: Csr) -> Links:
    """The entries of left times right, row by row (Gustavson)."""
    row = np.repeat(np.arange(len(left.starts) - 1), np.diff(left.starts))
    sizes = np.diff(right.starts)[left.columns]
    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    # each entry of the left matrix is replaced by the row of the right one that it points to
    column = right.columns[np.arange(n) + np.repeat(right.starts[left.columns] - (total - sizes), sizes)]
    row = np.repeat(row, sizes)
    if len(column) and ((np.diff(column) < 0) & (np.diff(row) == 0)).any():
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
    fresh = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (column[1:] != column[:-1])][:n])
    return Links(row[fresh], column[fresh], np.diff(np.r_[fresh, n]))


class Aligned(NamedTuple):
    """Stacked tokens of documents: ids, byte lengths and groups of A and of B, how many tokens each document has, and how many groups."""

    a: np.ndarray
    b: np.ndarray
    a_size: np.ndarray
    b_size: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_docs: np.ndarray
    b_docs: np.ndarray
    groups: int


@functools.lru_cache(maxsize=2)
def piece_reader(path: str):
    """(encode many texts, bytes of each id) of a piece vocabulary."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(read.get_piece_size()):
        piece = read.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if read.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: read.encode(texts, num_threads=1), table


def aligned(texts: list[str], a_path: str, b_path: str) -> Aligned:
    encode, pieces = piece_reader(b_path)
    a_bytes = byte_tokens(a_path)
    a_docs, b_docs = encoder(a_path)([f" {t}" if t else "" for t in texts]), encode(texts)
    for k, text in enumerate(texts):
        whole = f" {text}".encode()
        if not text or b"".join(map(a_bytes.__getitem__, a_docs[k])) != whole or b"".join(map(pieces.__getitem__, b_docs[k])) != whole:
            a_docs[k], b_docs[k] = [], []
    sides = []
    for lists, table in ((a_docs, a_bytes), (b_docs, pieces)):
        n = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
        sides.append((ids, _sizes(table)[ids], n))
    (a, a_size, a_n), (b, b_size, b_n) = sides
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    return Aligned(a, b, a_size, b_size, np.searchsorted(both, a_end), np.searchsorted(both, b_end), a_n, b_n, len(both))


_SIZES: dict[int, np.ndarray] = {}


def _sizes(table: list[bytes]) -> np.ndarray:
    found = _SIZES.get(id(table))
    if found is None:
        found = _SIZES[id(table)] = np.array([len(x) for x in table], np.int64)
    return found


def overlaps(t: Aligned) -> Iterator[Links]:
    """The overlap links of stacked tokens, a stretch at a time: row and column number the tokens of A and B, value is the bytes shared."""
    at = a = b = 0
    a_upto, b_upto = np.cumsum(t.a_size), np.cumsum(t.b_size)
    while a < len(t.a):
        # the last group that ends within the stretch, or else the next one
        to = max(int(np.searchsorted(a_upto, at + STRETCH, "right")), a + 1)
        group = t.a_group[to - 1] if to == len(t.a) or t.a_group[to] != t.a_group[to - 1] else max(t.a_group[to - 1] - 1, t.a_group[a])
        to, b_to = (int(np.searchsorted(x, group, "right")) for x in (t.a_group, t.b_group))
        links = product(incidence(t.a_size[a:to]), transposed(incidence(t.b_size[b:b_to]), int(b_upto[b_to - 1]) - at))
        yield Links(links.row + a, links.column + b, links.value)
        a, b, at = to, b_to, int(a_upto[to - 1])


def group_links(t: Aligned) -> Iterator[Links]:
    """The shared-group links of stacked tokens, some rows of A at a time."""
    groups_of_b = Csr(np.arange(len(t.b) + 1), t.b_group)
    tokens_of_group = transposed(groups_of_b, t.groups)
    upto = np.cumsum(np.bincount(t.b_group, minlength=t.groups)[t.a_group])
    a = 0
    while a < len(t.a):
        to = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STRETCH, "right")))
        links = product(Csr(np.arange(to - a + 1), t.a_group[a:to]), tokens_of_group)
        yield Links(links.row + a, links.column, links.value)
        a = to


@functools.lru_cache(maxsize=2)
def _signed(n_a: int, n_b: int) -> list[str]:
    """Each id's decimal digits and what follows: A's with comma and with bar, B's with comma and with semicolon."""
    return [f"{i}{sign}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for sign in signs for i in range(n)]


def group_texts(t: Aligned, n_a: int, n_b: int) -> list[str]:
    """For each document its groups, `a1,a2|b1;a3|b2,b3` in ids."""
    a_last, b_last = (np.r_[g[1:] != g[:-1], True][: len(g)] for g in (t.a_group, t.b_group))
    a_before = np.searchsorted(t.b_group, t.a_group)
    b_before = np.searchsorted(t.a_group, t.b_group, "right")
    mixed = np.empty(len(t.a) + len(t.b), np.int64)
    mixed[np.arange(len(t.a)) + a_before] = t.a + n_a * a_last
    mixed[np.arange(len(t.b)) + b_before] = t.b + 2 * n_a + n_b * b_last
    signed = _signed(n_a, n_b)
    ends = np.cumsum(t.a_docs + t.b_docs).tolist()
    return ["".join(map(signed.__getitem__, mixed[s:e].tolist()))[:-1] for s, e in zip([0, *ends], ends, strict=False)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about BLOCK_CHARS."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column("text"), strict=True):
            text = t.as_py() or ""
            if ids and size + len(text) > BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text)
        if ids:
            yield ids, texts


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row of docs.

    groups: as text; pairs: the document's distinct linked pairs of ids, a * PAIR_BASE + b; times: how often each is linked.
    """
    a_path, b_path = a_path or vocabulary("byte_bpe_50k.tiktoken"), b_path or vocabulary("piece_bpe_32k.model")
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def make(batches):
        n_a, n_b = len(byte_tokens(a_path)), len(piece_reader(b_path)[1])
        for ids, texts in _blocks(batches):
            t = aligned(texts, a_path, b_path)
            doc_of_a = np.repeat(np.arange(len(ids)), t.a_docs)
            keys = [np.empty(0, np.int64), *[doc_of_a[x.row] << 32 | t.a[x.row] * PAIR_BASE + t.b[x.column] for x in overlaps(t)]]
            keys, times = np.unique(np.concatenate(keys), return_counts=True)
            doc = keys >> 32
            groups = np.bincount(doc_of_a[np.r_[t.a_group[1:] != t.a_group[:-1], True][: len(t.a)]], minlength=len(ids))
            links = np.bincount(doc, times, len(ids)).astype(np.int64)
            at = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=len(ids)))].astype(np.int32))
            listed = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (keys & 0xFFFFFFFF, times)]
            columns = [pa.array(ids, pa.int64()), *[pa.array(x, pa.int64()) for x in (t.a_docs, t.b_docs, groups, links)], pa.array(group_texts(t, n_a, n_b)), *listed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "groups", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, f"doc_id long, {', '.join(f'{c} long' for c in counts)}, groups string, pairs array<int>, times array<int>")


def linked_tokens(docs: DataFrame, by: str = "bytes", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, shared): a row per link; shared: bytes (by="bytes"), or 1 (by="groups")."""
    a_path, b_path = a_path or vocabulary("byte_bpe_50k.tiktoken"), b_path or vocabulary("piece_bpe_32k.model")
    links_of = {"bytes": overlaps, "groups": group_links}[by]

    def make(batches):
        for ids, texts in _blocks(batches):
            t = aligned(texts, a_path, b_path)
            doc_of_a = np.repeat(np.arange(len(ids)), t.a_docs)
            first_a, first_b = (np.r_[0, np.cumsum(n)] for n in (t.a_docs, t.b_docs))
            for x in links_of(t):
                doc = doc_of_a[x.row]
                columns = [x.row - first_a[doc], x.column - first_b[doc], t.a[x.row], t.b[x.column], x.value]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "a_at", "b_at", "a_id", "b_id", "shared"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, a_at long, b_at long, a_id long, b_id long, shared long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold each pair of column pairs, and 1 where no pair of the same A id has more, else 0."""
    counted = settle(pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a_id", F.floor(F.col("pair") / PAIR_BASE).cast("int")))
    most = counted.groupBy("a_id").agg(F.max("n").alias("most"))
    return counted.join(most, "a_id").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def alignment_scores(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    n_best: links whose pair no other pair of its A id exceeds in documents; count_sum: documents over all links.
    """
    with scratch(docs.sparkSession) as keep:
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        made = align(docs, a_path, b_path).withColumn("groups_sha256", digest).drop("groups")
        rows = settle(made.withColumn("row", F.monotonically_increasing_id()))
        counts = settle(pair_counts(rows))
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        met = each.join(small_side(counts, counts.count(), BROADCAST_PAIRS), "pair")
        sums = met.groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        both = rows.drop("pairs", "times").join(sums, "row", "left")
        return keep(
            both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
        )
