"""Event-sourced recovery: folds of a capture journal (archive_id, seq, t, norm, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.operators.scans import deal, scan, undealt


def pending(records: DataFrame) -> DataFrame:
    """Queued and never taken, in order of their first queueing."""
    queued = records.where("t = 'enq'").groupBy("archive_id", "norm").agg(F.min("seq").alias("seq"))
    return queued.join(records.where("t = 'deq'"), ["archive_id", "norm"], "left_anti")


def interrupted(records: DataFrame) -> DataFrame:
    """Queued and taken, but neither captured nor failed."""
    keys = ["archive_id", "norm"]
    taken = records.where("t = 'enq'").select(*keys).distinct().join(records.where("t = 'deq'"), keys, "left_semi")
    return taken.join(records.where("t in ('page', 'failure')"), keys, "left_anti")


def state(records: DataFrame) -> DataFrame:
    """Counts and the last statistics of each capture."""
    n = lambda t: F.count_if(F.col("t") == t)
    return records.groupBy("archive_id").agg(
        n("page").alias("n_pages"),
        n("failure").alias("n_failures"),
        n("enq").alias("n_discovered"),
        F.max_by(F.when(F.col("t") == "stat", F.col("value")), F.when(F.col("t") == "stat", F.col("seq"))).alias("last_value"),
        (n("page") > 0).alias("can_finish"),
    )


def streaks(records: DataFrame, bad: str = "failure", every: int = 3) -> DataFrame:
    """(archive_id, seq, streak): consecutive bad records, and whether each completes another run of every."""
    flagged = records.select("archive_id", "seq", (F.col("t") == bad).alias("bad"))
    rows = scan(deal(flagged, ["archive_id"], ["seq"]), ["seq"], before={"n": F.col("bad").cast("int")})
    rows = rows.withColumn("n", F.col("n") + F.coalesce(F.col("bad").cast("int"), F.lit(0)))
    rows = scan(rows, ["seq"], latest={"ended": F.when(~F.col("bad"), F.col("n"))})
    streak = (F.col("n") - F.coalesce(F.col("ended"), F.lit(0))).cast("int")
    return rows.where("bad").withColumn("streak", streak).select("archive_id", "seq", "streak", (F.col("streak") % every == 0).alias("triggers"))


def referrers(visits: DataFrame) -> DataFrame:
    """The page before, per tab."""
    return undealt(scan(deal(visits, ["archive_id"], ["seq"]), ["seq"], previous={"referrer": F.col("norm")}))


def debounced(visits: DataFrame, gap_seconds: int) -> DataFrame:
    """The last visit of each run of visits that follow within the gap, per tab."""
    order = ["ts", "seq"]
    rows = undealt(scan(deal(visits, ["archive_id"], order), order, following={"_next": F.col("ts")}))
    return rows.where(F.col("_next").isNull() | (F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > gap_seconds * 1_000_000)).drop("_next")
