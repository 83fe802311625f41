"""Ordered scans within groups of any size: previous and following rows, running sums and latest values.

A window over one capture, tab or thread puts all its rows into one task. Here rows are dealt into ranges of (group, order)
first, so that a large group is spread over many tasks. Each range is scanned alone; a row for each group and range then carries
what lies before or after it, and is joined back. Equal rows in group and order fall into one range, where their
turn is as undefined as in a window. Null groups and null orders are values of their own, nulls first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.sources.tables import settle

GROUP, RANGE = "_scan_group", "_scan_range"


def deal(rows: DataFrame, group: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows with GROUP and RANGE, in ranges of near equal size (spark.sql.shuffle.partitions of them unless given).

    The ranges are written to the shared folder, as both passes of a scan must see the same ones even if executors are lost.
    """
    count = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn(GROUP, F.struct(*group))
    return settle(keyed.repartitionByRange(count, GROUP, *order).withColumn(RANGE, F.spark_partition_id()))


def scan(
    dealt: DataFrame,
    order: Sequence[str],
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """dealt rows with new columns by name: the value of the row before or after (previous, following), the sum
    over all rows before, 0 for the first (before), and the last value up to the row that isn't null (latest)."""
    previous, following, before, latest = (dict(each or {}) for each in (previous, following, before, latest))
    turn = F.struct(*order)
    # one row for each group and range: its ends, sums and last values
    ends = {f"_c_{n}": F.max_by(F.struct(v.alias("v")), turn) for n, v in previous.items()}
    ends |= {f"_c_{n}": F.min_by(F.struct(v.alias("v")), turn) for n, v in following.items()}
    ends |= {f"_c_{n}": F.sum(v) for n, v in before.items()}
    ends |= {f"_c_{n}": F.max_by(v, F.when(v.isNotNull(), turn)) for n, v in latest.items()}
    along = Window.partitionBy(GROUP).orderBy(RANGE)
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c_{n}": F.lag(f"_c_{n}").over(along)["v"] for n in previous}
    carried |= {f"_c_{n}": F.lead(f"_c_{n}").over(along)["v"] for n in following}
    carried |= {f"_c_{n}": F.coalesce(F.sum(f"_c_{n}").over(past), F.lit(0)) for n in before}
    carried |= {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(past) for n in latest}
    summary = dealt.groupBy(GROUP, RANGE).agg(*[c.alias(n) for n, c in ends.items()])
    summary = summary.select(GROUP, RANGE, *[c.alias(n) for n, c in carried.items()])

    within = Window.partitionBy(GROUP, RANGE).orderBy(*order)
    local = {f"_l_{n}": F.lag(v).over(within) for n, v in previous.items()}
    local |= {f"_l_{n}": F.lead(v).over(within) for n, v in following.items()}
    local |= {f"_l_{n}": F.sum(v).over(within.rowsBetween(Window.unboundedPreceding, -1)) for n, v in before.items()}
    local |= {f"_l_{n}": F.last(v, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)) for n, v in latest.items()}
    local |= {"_l_starts": F.row_number().over(within) == 1, "_l_ends": F.lead(F.lit(True)).over(within).isNull()}

    new = {n: F.when(F.col("_l_starts"), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")) for n in previous}
    new |= {n: F.when(F.col("_l_ends"), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")) for n in following}
    new |= {n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}") for n in before}
    new |= {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in latest}
    kept = [F.col(c) for c in dealt.columns if c not in new]
    scanned = dealt.withColumns(local).join(summary, [GROUP, RANGE])
    return scanned.select(*kept, *[c.alias(n) for n, c in new.items()])


def undealt(dealt: DataFrame) -> DataFrame:
    return dealt.drop(GROUP, RANGE)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with their number within the group, from 1."""
    counted = undealt(scan(deal(rows, group, order), order, before={name: F.lit(1)}))
    return counted.withColumn(name, (F.col(name) + 1).cast("int"))
