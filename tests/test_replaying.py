"""Streams of journal records against a plain fold, against the batch form, and stopped in the middle."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagestrata.operators import replay
from pagestrata.sources.tables import new_path
from pagestrata.streaming import replaying

SCHEMA = "archive_id long, seq long, ts timestamp, t string, norm string, sha string, url string, title string, target string, post_id string, kind string, total long"
TYPES = ["page", "asset", "assetUrl", "response", "route", "forumPost", "failure", "enq", "deq", "stat", "odd"]


def journal(seed, n, captures=3):
    from datetime import datetime, timedelta, timezone

    rnd = random.Random(seed)
    pick = lambda *xs: rnd.choice(xs)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return [
        (rnd.randrange(captures), i, start + timedelta(seconds=i), pick(*TYPES), pick("a", "b", "c", None), pick("s1", "s2"), pick("u1", "u2", "u3"), pick("", "T", f"T{i}"), f"p{i}", pick("x#1", "x#2"), "timeout", i * 10)
        for i in range(n)
    ]


def fold(rows):
    """The replay of one record after the other."""
    out = {}
    for capture in {r[0] for r in rows}:
        enq, taken, resolved, assets, state, n = {}, set(), set(), {}, {}, 0
        for _, seq, _, t, norm, sha, url, title, target, post, kind, total in sorted((r for r in rows if r[0] == capture), key=lambda r: r[1]):
            norm = norm or ""
            if t == "page":
                state["page", str(seq)] = seq, norm
                resolved.add(norm)
            elif t == "failure":
                state["failure", str(seq)] = seq, f"{kind}|{norm}"
                resolved.add(norm)
            elif t == "forumPost":
                state["post", str(seq)] = seq, post
            elif t == "asset":
                assets[sha] = seq, f"{kind}|{url}", [url], {}
            elif t == "assetUrl" and sha in assets and url not in assets[sha][2]:
                assets[sha][2].append(url)
                assets[sha][3][url] = seq
            elif t == "response":
                state["response", sha] = seq, url
            elif t == "route":
                state["route", norm] = seq, target
            elif t == "enq":
                enq.setdefault(norm, seq)
                n += 1
                state["discovered", ""] = seq, str(n)
            elif t == "deq":
                taken.add(norm)
            elif t == "stat":
                state["stat", ""] = seq, str(total)
                if title:
                    state["title", ""] = seq, title
        for sha, (seq, value, _, added) in assets.items():
            state["asset", sha] = seq, value
            state |= {("source", f"{sha} {u}"): (s, u) for u, s in added.items()}
        state |= {("queue", x): (s, None) for x, s in enq.items() if x not in taken}
        state |= {("interrupted", x): (s, None) for x, s in enq.items() if x in taken and x not in resolved}
        out |= {(capture, *k): v for k, v in state.items()}
    return out


def rows_of(df):
    return {(r.archive_id, r.what, r.key): (r.seq, r.value) for r in df.collect()}


def feed(spark, folder, parts):
    """A stream that reads one part a micro-batch."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.mark.parametrize("seed,order", [(1, "kept"), (2, "shuffled"), (3, "reversed")])
def test_batch_and_stream_equal_a_fold(spark, seed, order):
    rows = journal(seed, 160)
    wanted = fold(rows)
    assert rows_of(replay.entries(spark.createDataFrame(rows, SCHEMA))) == wanted
    come = {"kept": rows, "reversed": rows[::-1], "shuffled": random.Random(9).sample(rows, len(rows))}[order]
    path = new_path(spark)
    stream = replaying.entries(feed(spark, new_path(spark), [come[k : k + 40] for k in range(0, 160, 40)]))
    replaying.started(stream, path).awaitTermination()
    assert rows_of(replaying.kept(spark, path)) == wanted


def test_a_run_taken_up_again_equals_one_run_and_is_discarded(spark):
    rows = journal(4, 120)
    folder, path = new_path(spark), new_path(spark)
    source = feed(spark, folder, [rows[:40], rows[40:80]])
    replaying.started(replaying.entries(source), path).awaitTermination()
    assert rows_of(replaying.kept(spark, path)) == fold(rows[:80])
    held = replaying.kept(spark, path)
    spark.createDataFrame(rows[80:], SCHEMA).coalesce(1).write.parquet(f"{folder}/part=2")
    replaying.started(replaying.entries(source), path).awaitTermination()
    assert rows_of(replaying.kept(spark, path)) == fold(rows)
    assert rows_of(held) == fold(rows[:80])
    assert replaying.discard(spark, path) and replaying.discard(spark, path)
    with pytest.raises(FileNotFoundError):
        replaying.kept(spark, path)


def test_a_batch_that_was_applied_is_not_applied_again(spark):
    from pagestrata.sources.keyed_table import KeyedTable

    table = KeyedTable.create(spark, new_path(spark), "k long, v string", ["k"])
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    assert table.put(rows, 0) and not table.put(rows.withColumn("v", F.lit("b")), 0)
    assert table.put(rows.withColumn("v", F.lit("c")), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, "c")]


def test_state_goes_after_a_finish(spark):
    from datetime import datetime, timezone

    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    of = lambda capture, seq, d, t: (capture, seq, day(d), t, f"n{seq}", "s", "u", "T", "p", "x", "k", 1)
    parts = [[of(1, i, 1, "enq") for i in range(30)] + [of(1, 30, 1, "finish"), of(2, 1, 1, "enq")], [of(2, 2, 10, "enq")], [of(2, 3, 20, "enq")]]
    path = new_path(spark)
    run = replaying.started(replaying.entries(feed(spark, new_path(spark), parts), late="1 hour"), path)
    run.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert max(kept) > 30 and kept[-1] < 15
    assert len(rows_of(replaying.kept(spark, path))) == 30 + 3 + 2


def test_state_is_asked_for_once_a_key_and_never_where_it_is_empty():
    class State(dict):
        asked = 0

        def exists(self):
            return bool(self)

        def getValue(self, key):
            self.asked += 1
            return self.get(key)

    for held, asked in (({}, 0), ({("a",): (1,)}, 2)):
        state = State(held)
        cached = replaying.Cached(state)
        assert [cached["a"], cached["b"], cached["a"]] == [held.get(("a",)), None, held.get(("a",))] and state.asked == asked


class Held(dict):
    """Map state that counts the calls to it."""

    calls = 0

    def exists(self):
        self.calls += 1
        return bool(self)

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]

    def iterator(self):
        self.calls += 1
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Held())

    def registerTimer(self, at):
        self.timers.append(at)


def packed(rows):
    """Records of one capture as the processor gets them."""
    for _, seq, ts, t, norm, sha, url, title, target, post, kind, total in rows:
        name = sha if t in ("asset", "assetUrl", "response") else post if t == "forumPost" else title if t == "stat" else norm
        more = str(total) if t == "stat" else str(int(ts.timestamp() * 1000)) if t == "finish" else kind
        yield None, None, json.dumps([str(seq), t, name or "", target if t == "route" else url, more])


def run_parts(parts):
    """(entries kept, calls to the state a part, handle) of one capture's parts, each a micro-batch."""
    handle, kept, calls = Handle(), {}, []
    for part in parts:
        replay_ = replaying.Replay()
        replay_.init(handle)
        before = sum(s.calls for s in handle.states.values())
        for row in replay_.handleInputRows((0,), packed(part), None):
            for what, key, seq, value, gone in row.changes:
                if gone:
                    kept.pop((0, what, key), None)
                else:
                    kept[0, what, key] = seq, value
        calls.append(sum(s.calls for s in handle.states.values()) - before)
    return kept, calls, handle


def named(seed, n, names, types=TYPES):
    rnd = random.Random(seed)
    return [(0, *r[1:3], rnd.choice(types), f"n{rnd.randrange(names)}", f"s{rnd.randrange(names // 4 + 1)}", *r[6:]) for r in journal(seed, n, 1)]


def test_a_small_capture_takes_two_calls_a_micro_batch():
    rows = named(5, 120, 60)
    random.Random(1).shuffle(rows)
    kept, calls, _ = run_parts([rows[k : k + 40] for k in range(0, 120, 40)])
    assert kept == fold(rows) and max(calls) <= 2


@pytest.mark.parametrize("seed,full,short", [(1, 8, 3), (2, 5, 1000), (3, 1000, 0), (4, 64, 10)])
def test_texts_and_rows_of_state_hold_what_a_fold_holds(monkeypatch, seed, full, short):
    monkeypatch.setattr(replaying, "FULL", full)
    monkeypatch.setattr(replaying, "SHORT", short)
    rows = named(seed, 700, 90)
    random.Random(seed).shuffle(rows)
    cuts = [0, 3, 10, 60, 200, 201, 500, 700]
    kept, _, handle = run_parts([rows[a:b] for a, b in zip(cuts, cuts[1:])])
    assert kept == fold(rows)
    n, n_names, n_open, long = replaying.Known(handle.states["texts"], handle.states["places"])._text(0)[""]
    texts = [len(json.loads(t)) for (t,) in handle.states["texts"].values()]
    assert sum(texts) - 1 == n_names <= full * n and len(texts) == n
    assert n_open == sum(k[1] == "queue" for k in kept) and len(handle.states["places"]) == (n_open if long else 0)


def test_a_few_records_touch_little_of_a_large_capture():
    rows = named(6, 20_000, 9_000, ["enq", "deq", "page", "asset"])
    kept, calls, handle = run_parts([rows, named(7, 3, 9_000, ["enq", "deq"])])
    assert len(handle.states["texts"]) > 20 and len(handle.states["places"]) > 1000 and calls[1] <= 3 * 4 + 2


def test_a_total_of_zero_is_a_total():
    row = list(journal(1, 1)[0])
    row[3], row[-1], row[7] = "stat", 0, ""
    assert run_parts([[tuple(row)]])[0] == {(0, "stat", ""): (0, "0")}


def test_a_stream_of_a_large_capture_equals_a_fold(spark):
    rows = named(8, 2400, 800)
    random.Random(8).shuffle(rows)
    path = new_path(spark)
    stream = replaying.entries(feed(spark, new_path(spark), [rows[:1200], rows[1200:2300], rows[2300:]]))
    replaying.started(stream, path).awaitTermination()
    assert rows_of(replaying.kept(spark, path)) == fold(rows)


def test_commits_write_their_changes_and_the_session_keeps_its_settings(spark):
    import os

    before = {k: spark.conf.get(k, None) for k in replaying.STORE}
    rows, path = journal(9, 20), new_path(spark)
    replaying.started(replaying.entries(feed(spark, new_path(spark), [rows])), path).awaitTermination()
    assert {k: spark.conf.get(k, None) for k in replaying.STORE} == before
    assert any(f.endswith(".changelog") for _, _, files in os.walk(f"{path}/checkpoint/state") for f in files)
