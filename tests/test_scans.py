"""Scans by ranges equal windows over whole groups, with one group of nine tenths of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestrata.operators import budget, journal, scans

SCHEMA = "archive_id int, seq int, t string, norm string, ts timestamp, size int"


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    kinds, rows = ["failure", "failure", "failure", "page", "stat", None], []
    for seq in range(3000):
        who = 1 if rng.random() < 0.9 else rng.choice([2, 3, None])
        norm = rng.choice(["a", "b", None])
        rows.append((who, seq, rng.choice(kinds), norm, None, rng.choice([None, 1, 5])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 7 + F.pmod(F.hash("seq"), F.lit(5)) * 4))


def listed(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_all_scans_equal_windows(records):
    order = Window.partitionBy("archive_id").orderBy("seq")
    sums = order.rowsBetween(Window.unboundedPreceding, -1)
    new = {
        "p": F.lag("norm").over(order),
        "f": F.lead("norm").over(order),
        "b": F.coalesce(F.sum("size").over(sums), F.lit(0)),
        "l": F.last("norm", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    }
    dealt = scans.deal(records, ["archive_id"], ["seq"], 16)
    norm = F.col("norm")
    own = scans.scan(dealt, ["seq"], previous={"p": norm}, following={"f": norm}, before={"b": F.col("size")}, latest={"l": norm})
    columns = ["archive_id", "seq", "p", "f", "b", "l"]
    assert listed(own, *columns) == listed(records.withColumns(new), *columns)


def test_a_large_group_is_spread(records):
    dealt = scans.deal(records, ["archive_id"], ["seq"], 16)
    sizes = [r["count"] for r in dealt.groupBy(scans.GROUP, scans.RANGE).count().collect()]
    assert sum(sizes) == records.count()
    assert max(sizes) < 3000 / 16 * 2


def test_operators_equal_windows(records):
    order = Window.partitionBy("archive_id").orderBy("seq")
    rows = records.withColumn("bad", F.col("t") == "failure").withColumn("island", F.sum((~F.col("bad")).cast("int")).over(order))
    streak = F.row_number().over(Window.partitionBy("archive_id", F.coalesce("island", F.lit(0)), "bad").orderBy("seq"))
    expected = rows.where("bad").withColumn("streak", streak)
    assert listed(journal.streaks(records), "archive_id", "seq", "streak") == listed(expected, "archive_id", "seq", "streak")

    expected = records.withColumn("page_index", F.row_number().over(order))
    assert listed(scans.numbered(records, ["archive_id"], ["seq"], "page_index"), "archive_id", "seq", "page_index") == listed(expected, "archive_id", "seq", "page_index")

    times = Window.partitionBy("archive_id").orderBy("ts", "seq")
    after = F.lead("ts").over(times)
    expected = records.withColumn("n", after).where("n is null or unix_micros(n) - unix_micros(ts) > 8000000")
    assert listed(journal.debounced(records, 8), "archive_id", "seq") == listed(expected, "archive_id", "seq")

    expected = records.withColumn("l", F.lag("norm").over(order)).where("l is null or not norm <=> l")
    assert listed(budget.without_repeats(records), "archive_id", "seq") == listed(expected, "archive_id", "seq")

    taken = {r["archive_id"]: (r["n_pages"], r["n_bytes"], r["stopped_by"]) for r in budget.within_budget(records, 1000, 900).collect()}
    for who in [1, 2, 3, None]:
        n = total = 0
        sizes = [r["size"] or 0 for r in sorted(records.where(F.col("archive_id").eqNullSafe(F.lit(who).cast("int"))).collect(), key=lambda r: r["seq"])]
        while n < len(sizes) and total < 900 and n < 1000:
            total, n = total + sizes[n], n + 1
        assert taken[who][:2] == (n, total)


def test_empty_rows(records):
    assert scans.numbered(records.limit(0), ["archive_id"], ["seq"], "n").count() == 0
    assert journal.streaks(records.limit(0)).count() == 0
