"""The replay of capture journals as a stream: state per capture, changes of entries as output.

Records of a capture are folded in whatever order they come: what the last record wins by its
seq, what is appended goes straight out, and what waits for other records (places of the queue,
sources of assets) stays in map state, which RocksDB holds on disk. A micro-batch's records are
folded by name first, and each name then meets its state once. As a call to the state takes
longer than the few records of most captures, names are dealt by hash to texts, one for a small
capture and more as its names need; the open places of a long queue are rows of their own. So a
micro-batch touches the texts and places of its own names only. Output are the entries of
operators.replay.entries that changed, those that no longer hold marked as gone, so that the
newest row of each key is the state.

A finish record lets a capture's state go once the watermark is LINGER past it, by a timer; what
comes later than that is late, and Spark drops it.

A sink is a KeyedTable: each micro-batch is one change with the batch's number, so that a
run that was stopped in the middle and is started again from its checkpoint gives what one run
gives. discard() deletes a checkpoint and its table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagestrata.sources import versions
from pagestrata.sources.keyed_table import KeyedTable

LINGER_MS = 3_600_000
ENTRY = "archive_id long, what string, key string, seq long, value string"
CHANGES = "archive_id long, changes array<struct<what: string, key: string, seq: long, value: string, _gone: boolean>>"
#: Changes of one row that the operator gives out.
ROW = 10_000
#: Names that a capture's texts of state hold on average; when they hold more, the names are dealt to more texts.
FULL = 256
#: Open places that stay in texts; a queue that was once longer has a row each for its open places.
SHORT = 24
#: How a run's state is held; a commit writes its changes, and now and then the whole state.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Cached:
    """Map state of which each key is read once and written once a micro-batch; the keys of an empty one aren't asked for."""

    def __init__(self, state, holds: bool | None = None):
        self.state, self.now, self.before, self.holds = state, {}, {}, holds

    def __getitem__(self, key):
        if key not in self.now:
            if self.holds is None:
                self.holds = self.state.exists()
            value = self.state.getValue((key,)) if self.holds else None
            self.now[key] = self.before[key] = None if value is None else tuple(value)
        return self.now[key]

    def __setitem__(self, key, value: tuple | None) -> None:
        _ = self[key]
        self.now[key] = value

    def fill(self) -> None:
        """Reads all keys together; no other is there."""
        for (key,), value in self.state.iterator():
            self.now[key] = self.before[key] = tuple(value)
        self.holds = False

    def save(self) -> None:
        for key, value in self.now.items():
            if value is None and self.before[key] is not None:
                self.state.removeKey((key,))
            elif value != self.before[key]:
                self.state.updateValue((key,), value)


def waits(place: list | None) -> bool:
    """Whether a place (first seq, taken, resolved) is open: queued and not taken."""
    return place is not None and place[0] is not None and not place[1]


def interrupted(place: list | None) -> bool:
    return place is not None and place[0] is not None and place[1] and not place[2]


class Known:
    """What the state of a capture says of names. Text 0 also says how many texts, names in texts and open places there are, and whether these are rows."""

    def __init__(self, texts, places):
        self.texts, self.read = Cached(texts, True), {}
        self.n, self.n_names, self.n_open, self.long = self._text(0).get("", (1, 0, 0, False))
        self.places = Cached(places, self.long)

    def _text(self, number: int) -> dict:
        if number not in self.read:
            text = self.texts[number]
            self.read[number] = json.loads(text[0]) if text else {}
        return self.read[number]

    def _of(self, key: str) -> dict:
        return self._text(crc32(key.encode()) % self.n if self.n > 1 else 0)

    def _names(self) -> list[tuple[str, list]]:
        """All names in texts."""
        self.texts.fill()
        return [x for number in range(self.n) for x in self._text(number).items() if x[0]]

    def ask(self, norms: Iterable[str]) -> None:
        """Reads the open places together where these are not few among them."""
        if self.long and self.n_open <= 8 * sum(f"queue {n}" not in self._of(f"queue {n}") for n in norms):
            self.places.fill()

    def get(self, what: str, name: str) -> list | None:
        key = f"{what} {name}"
        found = self._of(key).get(key)
        if found is None and self.long and what == "queue" and (place := self.places[name]):
            return [place[0], False, place[1]]
        return found

    def put(self, what: str, name: str, before: list | None, now: list) -> None:
        key = f"{what} {name}"
        was, opens, text = what == "queue" and waits(before), what == "queue" and waits(now), self._of(key)
        self.n_open += opens - was
        if opens and self.long:
            self.n_names -= text.pop(key, None) is not None
            self.places[name] = (now[0], now[2])
        else:
            self.n_names += key not in text
            text[key] = now
            if was and self.long:
                self.places[name] = None

    def save(self) -> None:
        if self.n_open > SHORT and not self.long:
            self.long = True
            for key, place in self._names():
                if key.startswith("queue ") and waits(place):
                    self.put("queue", key.removeprefix("queue "), place, place)
        if self.n_names > FULL * self.n:
            names = self._names()
            self.n = 4 * len(names) // FULL
            self.read = {number: {} for number in range(self.n)}
            for key, value in names:
                self._of(key)[key] = value
        self._text(0)[""] = [self.n, self.n_names, self.n_open, self.long]
        for number, text in self.read.items():
            self.texts[number] = (json.dumps(text),)
        self.texts.save()
        self.places.save()


def sources(asset: list | None) -> dict[str, int]:
    """First seq of each URL that was added to an asset (seq, value, own URL, additions) after its last record."""
    first: dict[str, int] = {}
    if asset is not None and asset[1] is not None:
        for at, url in asset[3]:
            if url != asset[2]:
                first[url] = min(at, first.get(url, at))
    return first


def merged(what: str, a: list | None, b: list) -> list:
    """What a name's records say together, those of a and those of b, in whatever order they were written."""
    if what == "asset":
        last = b if a is None or b[0] > a[0] else a
        # additions before the asset's last record never count again
        return [*last[:3], [x for x in [*(a[3] if a else ()), *b[3]] if x[0] > last[0]]]
    if a is None:
        return b
    if what == "queue":
        return [min((s for s in (a[0], b[0]) if s is not None), default=None), a[1] or b[1], a[2] or b[2]]
    last = b if b[0] > a[0] else a
    if what == "discovered":
        return [last[0], a[1] + b[1]]
    return last


class Replay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "number int", "names string")
        self.places = handle.getMapState("places", "norm string", "seq long, resolved boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        said: dict[tuple[str, str], list] = {}
        out: dict[tuple[str, str], tuple] = {}

        def say(what: str, name: str, part: list) -> None:
            said[what, name] = merged(what, said.get((what, name)), part)

        def give(what: str, name: str, *entry) -> None:
            if (what, name) not in out or out[what, name] < entry:
                out[what, name] = entry

        for row in rows:
            seq, t, name, value, more = json.loads(row[2])
            seq = int(seq)
            if t in ("page", "failure"):
                give(t, str(seq), seq, name if t == "page" else f"{more}|{name}", False)
                say("queue", name, [None, False, True])
            elif t == "forumPost":
                give("post", str(seq), seq, name, False)
            elif t == "enq":
                say("queue", name, [seq, False, False])
                say("discovered", "", [seq, 1])
            elif t == "deq":
                say("queue", name, [None, True, False])
            elif t in ("asset", "assetUrl"):
                asset = said.setdefault(("asset", name), [-1, None, None, []])
                if t == "assetUrl":
                    asset[3].append([seq, value])
                elif seq > asset[0]:
                    asset[:3] = seq, f"{more}|{value}", value
            elif t in ("route", "response"):
                say(t, name, [seq, value])
            elif t == "stat":
                for what, last in (("stat", more), ("title", name)):
                    if last:
                        say(what, "", [seq, last])
            elif t == "finish":
                self.handle.registerTimer(int(more) + LINGER_MS)
        if said:
            known = Known(self.texts, self.places)
            known.ask(name for what, name in said if what == "queue")
            for (what, name), part in said.items():
                before = known.get(what, name)
                now = merged(what, before, part)
                if now == before:
                    continue
                known.put(what, name, before, now)
                if what == "queue":
                    for entry, holds in (("queue", waits), ("interrupted", interrupted)):
                        if holds(now) or holds(before):
                            give(entry, name, now[0], None, not holds(now))
                elif what != "asset":
                    give(what, name, now[0], str(now[1]), False)
                elif now[1] is not None:
                    give("asset", name, now[0], now[1], False)
                    have, had = sources(now), sources(before)
                    for u, s in have.items():
                        if had.get(u) != s:
                            give("source", f"{name} {u}", s, u, False)
                    for u, s in had.items():
                        if u not in have:
                            give("source", f"{name} {u}", s, u, True)
            known.save()
        entries = [(*k, *v) for k, v in out.items()]
        for k in range(0, len(entries), ROW):
            yield Row(archive_id=key[0], changes=entries[k : k + ROW])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.texts.clear()
        self.places.clear()
        return iter(())

    def close(self) -> None:
        pass


def entries(records: DataFrame, late: str = "30 days") -> DataFrame:
    """Changes of entries of a stream of records (archive_id, seq, ts, t, norm, ...); records later than late behind the newest are dropped."""
    text = ("norm", "sha", "url", "title", "target", "post_id", "kind")
    known = records.selectExpr("archive_id", "seq", "ts", "t", *[f"coalesce({c}, '') AS {c}" for c in text], "total").withWatermark("ts", late)
    # a record's name, what is said of it, and what else its type needs, as one text: each further column takes time in Python
    name = "CASE WHEN t IN ('asset', 'assetUrl', 'response') THEN sha WHEN t = 'forumPost' THEN post_id WHEN t = 'stat' THEN title ELSE norm END"
    value = "CASE t WHEN 'route' THEN target ELSE url END"
    more = "CASE t WHEN 'stat' THEN CAST(total AS STRING) WHEN 'finish' THEN CAST(unix_millis(ts) AS STRING) ELSE kind END"
    packed = known.selectExpr("archive_id", "ts", f"to_json(array(CAST(seq AS STRING), t, {name}, {value}, {more})) AS record")
    changes = packed.groupBy("archive_id").transformWithState(Replay(), CHANGES, "Update", "EventTime")
    return changes.select("archive_id", F.inline("changes"))


def started(changes: DataFrame, path: str, **trigger):
    """Begins, or takes up again, a run that keeps a table of entries at path."""
    spark = changes.sparkSession
    if not versions.numbers(spark, f"{path}/table"):
        KeyedTable.create(spark, f"{path}/table", ENTRY, ["archive_id", "what", "key"])
    put = lambda batch, number: KeyedTable(batch.sparkSession, f"{path}/table").put(batch, number)
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        writer = changes.writeStream.queryName(path).foreachBatch(put).outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The entries that a run has kept so far."""
    return KeyedTable(spark, f"{path}/table").read()


def discard(spark: SparkSession, path: str) -> bool:
    """Deletes a run's checkpoint and table; nothing there is no fault. False, and nothing is deleted, while the run goes on."""
    if any(q.name == path for q in spark.streams.active):
        return False
    versions.delete(spark, path)
    return True
