"""A kept positional index for full-text search, with changes as deltas.

Postings (term, column, key, tf, positions) are kept as blocks: a row holds up to BLOCK postings of a
term in a column, as lists of their keys and tfs, of all their positions one after the other, and of where each posting's begin. Blocks are dealt to files by (term, column,
first key) and sorted by term in each: a prefix is a range of each file's rows, so a search reads the row groups and
pages of that range only, and a term that every document holds is spread over all files. Beside
them stand the documents' lengths, a row each. Dealing by hash needs no sample of what is dealt, so a text is
split on its way to its files and isn't written before.

A change writes a generation of its own: postings and lengths of what it adds, and the keys
whose older rows are dead. Readers leave out rows of generations older than their key's newest
death; compact() merges generations into one. Each change publishes a version, so a reader keeps what it
began with, and a failed change leaves the version before.

Words of a query are ANDed; a word matches tokens by prefix in any column, a word of several
tokens is a phrase inside one column, met by the positions of its tokens, whose last one is a
prefix. Scores are those of operators.search, whose document frequencies and lengths cover every document of the index.

Defined cases: rows without a full key take no part; a key that is added again replaces
its document; a key twice in one addition is one document with both texts' tokens, one text after the other; null columns are empty;
blank words find nothing; an empty index finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators.search import ACCENTED, B, K1, LEAST_IDF, MARKS, query_words
from pagestrata.sources import versions


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def token_matches(phrase: list[str]) -> list[Column]:
    """For each token of a phrase, whether a posting's term is it; the last one by prefix."""
    return [*[F.col("term") == t for t in phrase[:-1]], F.col("term").startswith(phrase[-1])]


def _order(group: np.ndarray) -> np.ndarray:
    """Places by group, and by place in one; numbers of both are sorted several times faster than places by their groups."""
    bits = len(group).bit_length()
    if len(group) and int(group.max()).bit_length() + bits < 63:
        return np.sort((group.astype("int64") << bits) | np.arange(len(group))) & ((1 << bits) - 1)
    return np.argsort(group, kind="stable")


#: Tokens that are grouped at a time; a text of more is grouped alone.
BATCH_TOKENS = 1 << 20


def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (column, key, tokens) to rows (term, column, key, tf, positions in order), a row per term; no tokens: one row without term.

    Rows are taken together up to BATCH_TOKENS tokens.
    """
    for batch in batches:
        lists = batch.column("tokens")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_TOKENS, "right")))
            part, at = batch.slice(at, upto - at), upto
            n = pc.list_value_length(part.column("tokens")).to_numpy()
            rows, words = np.repeat(np.arange(len(n)), n), part.column("tokens").flatten()
            if not pa.types.is_dictionary(words.type):
                words = words.dictionary_encode()
            place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            group = rows * max(len(words.dictionary), 1) + words.indices.to_numpy()
            order = _order(group)
            firsts = np.flatnonzero(np.diff(group[order], prepend=-1))
            # rows without tokens follow those with
            bare = np.flatnonzero(n == 0)
            source = pa.array(np.concatenate([rows[order][firsts], bare]).astype("int64"))
            terms = pa.concat_arrays([words.take(pa.array(order[firsts])).dictionary_decode(), pa.nulls(len(bare), pa.string())])
            offsets = np.concatenate([firsts, np.full(len(bare) + 1, len(order))]).astype("int32")
            positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order].astype("int32")))
            made = {c: part.column(c).take(source) for c in part.schema.names if c != "tokens"}
            yield pa.RecordBatch.from_pydict({"term": terms} | made | {"tf": pa.array(np.diff(offsets).astype("int64")), "positions": positions})


#: Postings of one row, at most.
BLOCK = 512
#: Bytes of text that are cut into words at a time; a longer text is cut alone.
BATCH_BYTES = 1 << 23
#: How blocks are kept; an index that is kept otherwise isn't read.
LAYOUT = 3
#: Up to so many removed or replaced keys go to all tasks; with more, postings and keys are shuffled to meet.
BROADCAST_KEYS = 2_000_000

_IN_WORDS = np.zeros(256, bool)
_IN_WORDS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


#: Separators beyond ASCII. Marks stay until words lose them.
_ODD_SEPARATOR = r"[^\x00-\x7F\p{L}\p{N}\x{300}-\x{36F}]+"


class _Folds(dict):
    """What characters become; those that stay are noted when they are met, as str.translate takes a missing key for an error."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


_FOLD = _Folds(str.maketrans(ACCENTED | dict.fromkeys(MARKS)))


def plain_words(text: Column) -> Column:
    """Text whose runs of ASCII digits, small ASCII letters and characters beyond ASCII are search.tokens(text), once they have lost their accents."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(low, _ODD_SEPARATOR, " "))


def _without_accents(words: pa.DictionaryArray) -> pa.DictionaryArray:
    """Each different word is folded once; words of marks alone are empty then."""
    values = words.dictionary
    odd = pc.not_equal(pc.binary_length(values), pc.utf8_length(values))
    found = values.filter(odd)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(found)], found), "\n")[0].as_py()
    folded = pc.replace_with_mask(values, odd, pa.array(joined.translate(_FOLD).split("\n")[: len(found)], values.type)).dictionary_encode()
    return pa.DictionaryArray.from_arrays(folded.indices.take(words.indices), folded.dictionary)


def cut_words(texts: pa.Array) -> pa.Array:
    """Lists of the words of texts from plain_words, as dictionaries."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN_WORDS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype("int32")
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[inside])).dictionary_encode()
    offsets = np.searchsorted(np.flatnonzero(begins), ends)
    if len(data) and data.max() >= 0x80:
        words = _without_accents(words)
        bare = pc.index(words.dictionary, "").as_py()
        if bare >= 0:
            stays = words.indices.to_numpy() != bare
            words, offsets = words.filter(pa.array(stays)), np.append(0, np.cumsum(stays))[offsets]
    return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), words)


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    names = batches[0].schema.names
    flat = {c: pa.concat_arrays([b.column(c) for b in batches]) for c in names}
    terms, columns = flat["term"].fill_null("").dictionary_encode(), flat["column"].dictionary_encode()
    group = terms.indices.to_numpy().astype("int64") * len(columns.dictionary) + columns.indices.to_numpy()
    order = _order(group)
    firsts = np.flatnonzero(np.diff(group[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(firsts, np.diff(firsts, append=len(order)))
    starts = np.flatnonzero(place % BLOCK == 0)
    offsets = pa.array(np.append(starts, len(order)).astype("int32"))
    tfs = pc.list_value_length(flat["positions"]).to_numpy()[order].astype("int64")
    before = np.cumsum(tfs) - tfs
    begin = before - np.repeat(before[starts], np.diff(starts, append=len(order)))
    order, source = pa.array(order), pa.array(order[starts])
    made = {c: flat[c].take(source) if c in ("term", "column") else pa.ListArray.from_arrays(offsets, flat[c].take(order)) for c in names if c != "positions"}
    bounds = pa.array(np.append(before[starts], tfs.sum()).astype("int32"))
    positions = pa.ListArray.from_arrays(bounds, flat["positions"].take(order).flatten())
    return pa.RecordBatch.from_pydict(made | {"starts": pa.ListArray.from_arrays(offsets, pa.array(begin.astype("int32"))), "positions": positions})


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings to blocks, of as many batches together as have BATCH_TOKENS rows or positions."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += max(batch.num_rows, len(batch.column("positions").flatten()))
        if size >= BATCH_TOKENS:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (column, key, text) from plain_words to blocks of their postings, and to blocks without term whose tf is the number of a text's words."""

    def cut() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype="int64")
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
                part, at = batch.slice(at, upto - at), upto
                kept = {c: part.column(c) for c in part.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(kept | {"tokens": cut_words(part.column("text"))})

    for part in cut():
        kept = {c: part.column(c) for c in part.schema.names if c != "tokens"}
        n = pc.list_value_length(part.column("tokens")).cast(pa.int64())
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(n) + 1, "int32")), pa.array([], pa.int32()))
        yield _block([pa.RecordBatch.from_pydict({"term": pa.nulls(len(n), pa.string())} | kept | {"tf": n, "positions": none})])
        yield from blocks(b.filter(b.column("term").is_valid()) for b in by_term(iter([part])))


class TextIndex:
    """The index at a path; an instance reads the version that was the newest when it was made or last changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.version, self.content = versions.latest(spark, path)
        if not self.version:
            raise FileNotFoundError(f"no index at {path}")
        if self.content.get("layout") != LAYOUT:
            raise ValueError(f"the index at {path} has another layout; build it again")

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: list[str], columns: list[str]) -> TextIndex:
        types = dict(docs.dtypes)
        index = cls.__new__(cls)
        index.spark, index.path, index.version = docs.sparkSession, path, 0
        index.content = {"key": [[k, types[k]] for k in key], "columns": columns, "layout": LAYOUT, "generations": []}
        index._write(docs, None)
        return index

    @property
    def key(self) -> list[str]:
        return [k for k, _ in self.content["key"]]

    @property
    def columns(self) -> list[str]:
        return self.content["columns"]

    # Changes

    def add(self, docs: DataFrame) -> None:
        """Documents come in, or take the place of those with their keys."""
        self._write(docs, docs.select(*self.key))

    def remove(self, keys: DataFrame) -> None:
        self._write(None, keys.select(*self.key))

    def compact(self) -> None:
        """One generation with what is alive now."""
        live = self._live("postings", positions=True).select("term", "column", *self.key, "tf", "positions")
        made = self._written(live.mapInArrow(blocks, self._schema("postings")), self._live("lengths"), None)
        self._publish([made])

    def vacuum(self) -> None:
        """Deletes the data that the newest version doesn't name; readers of older versions lose theirs."""
        _, content = versions.latest(self.spark, self.path)
        used = {g["at"] for g in content["generations"]}
        fs, at = versions.hadoop(self.spark, f"{self.path}/data")
        for status in fs.listStatus(at):
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)

    def _write(self, docs: DataFrame | None, dead: DataFrame | None) -> None:
        if docs is None:
            self._publish([*self.content["generations"], self._written(None, None, dead)])
            return
        made = self._written(self._split(docs), None, dead)
        self._publish([*self.content["generations"], made])

    def _split(self, docs: DataFrame) -> DataFrame:
        """Blocks of documents' postings, and blocks without term of the lengths of their columns.

        Dealing by key, before anything is split, gives texts to all tasks, however few their files' row groups are. Texts
        are gathered by key only where a key comes twice, which the keys alone tell.
        """
        known = docs.where(_all([F.col(k).isNotNull() for k in self.key]))
        if known.groupBy(*self.key).count().where("count > 1").isEmpty():
            one = known.repartition(*self.key)
            texts = [F.col(c) for c in self.columns]
        else:
            one = known.groupBy(*self.key).agg(F.collect_list(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(self.columns)])).alias("_d"))
            texts = [F.array_join(F.sort_array("_d")[f"c{i}"], " ") for i in range(len(self.columns))]
        parts = [F.struct(F.lit(c).alias("column"), t.cast("string").alias("text")) for c, t in zip(self.columns, texts, strict=True)]
        each = one.select(*self.key, F.explode(F.array(*parts)).alias("_c"))
        return each.select("_c.column", *self.key, plain_words(F.col("_c.text")).alias("text")).mapInArrow(text_blocks, self._schema("postings"))

    def _lengths_of(self, split: DataFrame) -> DataFrame:
        return self._flat(split.where("term is null")).groupBy(*self.key).agg(*[F.sum(F.when(F.col("column") == c, F.col("tf"))).alias(f"n_{c}") for c in self.columns])

    def _written(self, postings: DataFrame | None, lengths: DataFrame | None, dead: DataFrame | None) -> dict:
        at = uuid.uuid4().hex
        made = {}
        if postings is not None:
            order = ["term", "column", *[F.get(k, F.lit(0)) for k in self.key]]
            made["postings"] = postings.repartition(*order).sortWithinPartitions(*order)
        if lengths is not None:
            made["lengths"] = lengths.select(*self.key, *[f"n_{c}" for c in self.columns])
        if dead is not None:
            made["dead"] = dead.dropna().distinct()
        for kind, df in made.items():
            df.write.parquet(f"{self.path}/data/{at}/{kind}")
        if postings is not None and lengths is None:
            # the blocks of lengths stand first in each file
            split = self.spark.read.schema(self._schema("postings")).parquet(f"{self.path}/data/{at}/postings")
            made["lengths"] = self._lengths_of(split)
            made["lengths"].write.parquet(f"{self.path}/data/{at}/lengths")
        n_dead = self.spark.read.parquet(f"{self.path}/data/{at}/dead").count() if "dead" in made else 0
        return {"at": at, "kinds": list(made), "n_dead": n_dead}

    def _publish(self, generations: list[dict]) -> None:
        content = self.content | {"generations": generations}
        versions.publish(self.spark, self.path, self.version + 1, content)
        self.version, self.content = self.version + 1, content

    # Reading

    def _schema(self, kind: str) -> str:
        key = ", ".join(f"`{k}` array<{t}>" if kind == "postings" else f"`{k}` {t}" for k, t in self.content["key"])
        more = {"postings": "tf array<long>, starts array<int>, positions array<int>", "lengths": ", ".join(f"`n_{c}` long" for c in self.columns), "dead": ""}[kind]
        return ", ".join(x for x in (("term string, column string" if kind == "postings" else ""), key, more) if x)

    def _generations(self, kind: str) -> list[DataFrame]:
        read = self.spark.read.schema(self._schema(kind))
        return [read.parquet(f"{self.path}/data/{g['at']}/{kind}").withColumn("_generation", F.lit(i)) for i, g in enumerate(self.content["generations"]) if kind in g["kinds"]]

    def _flat(self, kept: DataFrame, positions: bool = False) -> DataFrame:
        """A row per posting of blocks, with positions only where they are asked for, as they are most of what is read."""
        lists = [*self.key, *(["starts", "positions"] if positions else [])]
        others = [c for c in kept.columns if c not in (*self.key, "tf", "starts", "positions")]
        # values are taken out of their lists by place: zipped lists would be built anew for each block
        each = kept.select(*others, *lists, F.posexplode("tf").alias("_i", "tf"))
        own = [F.slice("positions", F.get("starts", F.col("_i")) + 1, F.col("tf").cast("int")).alias("positions")] if positions else []
        return each.select(*others, *[F.get(c, F.col("_i")).alias(c) for c in self.key], "tf", *own)

    def _live(self, kind: str, wanted: Callable[[DataFrame], DataFrame] = lambda df: df, positions: bool = False) -> DataFrame:
        """Rows of all generations that no later change has killed; wanted is applied to each generation's rows first, to blocks of postings."""
        flat = (lambda df: self._flat(wanted(df.where("term is not null")), positions)) if kind == "postings" else wanted
        parts = [flat(df) for df in self._generations(kind)]
        if not parts:
            return flat(self.spark.createDataFrame([], self._schema(kind)))
        rows = reduce(DataFrame.unionByName, parts)
        deaths = self._generations("dead")
        if deaths:
            newest = reduce(DataFrame.unionByName, deaths).groupBy(*self.key).agg(F.max("_generation").alias("_death"))
            if sum(g["n_dead"] for g in self.content["generations"]) <= BROADCAST_KEYS:
                newest = F.broadcast(newest)
            rows = rows.join(newest, self.key, "left").where(F.col("_death").isNull() | (F.col("_generation") >= F.col("_death"))).drop("_death")
        return rows.drop("_generation")

    def terms(self, columns: list[str] | None = None) -> DataFrame:
        """(term, n_docs, n_hits) over columns."""
        chosen = F.col("column").isin(columns or self.columns)
        each = self._live("postings", lambda df: df.where(chosen)).select("term", *self.key, "tf")
        if len(columns or self.columns) > 1:
            each = each.groupBy("term", *self.key).agg(F.sum("tf").alias("tf"))
        return each.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_hits"))

    def matches(self, text: str, weights: Mapping[str, int] | None = None) -> DataFrame:
        """(key, hit_0, hit_1, ...): for each document that any word of text matches, the weighted hits of each word."""
        phrases = query_words(text)
        weights = weights or dict.fromkeys(self.columns, 1)
        wanted = _any([_any(token_matches(p)) for p in phrases]) & F.col("column").isin(list(weights))
        rows = self._live("postings", lambda df: df.where(wanted), positions=any(len(p) > 1 for p in phrases))
        weight = reduce(lambda acc, cw: F.when(F.col("column") == cw[0], cw[1]).otherwise(acc), weights.items(), F.lit(0))
        single = [len(p) == 1 for p in phrases]
        if not all(single):
            # positions of a phrase's tokens, moved back to where the phrase would start, meet in one document's column
            starts = lambda k: F.transform("positions", lambda p: p - k)
            parts = []
            for i, p in enumerate(phrases):
                if single[i]:
                    parts.append(F.sum(F.when(token_matches(p)[0], F.col("tf"))).alias(f"hit_{i}"))
                else:
                    parts += [F.flatten(F.collect_list(F.when(m, starts(k)))).alias(f"_{i}_{k}") for k, m in enumerate(token_matches(p))]
            rows = rows.groupBy(*self.key, "column").agg(*parts)
            met = lambda i: F.size(reduce(F.array_intersect, [F.col(f"_{i}_{k}") for k in range(len(phrases[i]))]))
            hits = [F.coalesce(F.col(f"hit_{i}"), F.lit(0)) if single[i] else met(i) for i in range(len(phrases))]
        else:
            hits = [F.when(token_matches(p)[0], F.col("tf")).otherwise(0) for p in phrases]
        return rows.groupBy(*self.key).agg(*[F.sum(h * weight).cast("double").alias(f"hit_{i}") for i, h in enumerate(hits)])

    def search(self, text: str, weights: Mapping[str, int] | None = None) -> DataFrame:
        """(key, score) of the documents that match all words of text."""
        n_words = len(query_words(text))
        weights = weights or dict.fromkeys(self.columns, 1)
        if not n_words:
            return self.spark.createDataFrame([], self._schema("lengths")).select(*self.key, F.lit(0.0).alias("score"))
        # no key is null; said here, so that both uses of what is found are one plan and read postings once
        found = self.matches(text, weights).where(_all([F.col(k).isNotNull() for k in self.key]))
        length = reduce(lambda a, b: a + b, [F.col(f"n_{c}") for c in weights])
        lengths = self._live("lengths").select(*self.key, length.alias("_dl"))
        # two rows of one column each: broadcast joins without keys
        whole = lengths.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"))
        held = found.agg(*[F.count_if(F.col(f"hit_{i}") > 0).alias(f"_df{i}") for i in range(n_words)])
        met = found.where(_all([F.col(f"hit_{i}") > 0 for i in range(n_words)])).join(lengths, self.key)
        score = F.lit(0.0)
        for i in range(n_words):
            idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(LEAST_IDF))
            score = score - idf * F.col(f"hit_{i}") * (K1 + 1) / (F.col(f"hit_{i}") + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
        return met.join(F.broadcast(whole)).join(F.broadcast(held)).select(*self.key, score.alias("score"))
