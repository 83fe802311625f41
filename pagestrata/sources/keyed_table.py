"""A kept table by key, changed in place of its buckets only.

Rows are dealt to buckets by their key. A change (rows to put in, or keys that are gone) is
written once, a folder per touched bucket, and published as a version: untouched buckets
keep their files, readers keep the version they began with, and a failed change leaves the
version before. A key's row is that of its newest change. Buckets with over MOST_CHANGES
changes are merged when they are changed next.

Changes may carry a batch number, as a stream's micro-batches do: one that was applied already is
left out, so a stream that is restarted in the middle doesn't apply a batch twice.

Defined cases: a null part of a key is a key like any other; a key twice in one change keeps
one of its rows, the one with the greatest values in order of columns; changing keys that aren't there puts nothing in; an empty change publishes a version.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.sources import versions

BUCKETS, MOST_CHANGES = 16, 8
OWN = "_change long, _gone boolean"


class KeyedTable:
    """The table at a path; an instance reads the version that was the newest when it was made or last changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.version, self.content = versions.latest(spark, path)
        if not self.version:
            raise FileNotFoundError(f"no table at {path}")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = BUCKETS, info: dict | None = None) -> KeyedTable:
        """An empty table; schema: columns as DDL text; info: what the table's owner wants to keep beside its versions."""
        versions.publish(spark, path, 1, {"schema": schema, "key": key, "n": buckets, "batch": None, "folders": {}, "info": info or {}})
        return cls(spark, path)

    # Reading

    @property
    def key(self) -> list[str]:
        return self.content["key"]

    @property
    def info(self) -> dict:
        return self.content["info"]

    def files(self, bucket: int) -> list[str]:
        """The folders that hold a bucket, oldest first."""
        return self.content["folders"].get(str(bucket), [])

    def _stored(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{self.content['schema']}, {OWN}").parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _alive(self, buckets: list[str]) -> DataFrame:
        """(columns, _change) of the newest row of each key in buckets, without what is gone."""
        folders = self.content["folders"]
        once = [f[0] for b in buckets if len(f := folders[b]) == 1]
        often = [f for b in buckets if len(folders[b]) > 1 for f in folders[b]]
        parts = [self._stored(once)] if once else []
        if often:
            rows = self._stored(often)
            newest = F.max_by(F.struct(*rows.columns), "_change").alias("r")
            parts.append(rows.groupBy(*self.key).agg(newest).select("r.*"))
        if not parts:
            return self.spark.createDataFrame([], f"{self.content['schema']}, {OWN}").drop("_gone")
        return reduce(DataFrame.unionByName, parts).where("not _gone").drop("_gone")

    def read(self) -> DataFrame:
        return self._alive(list(self.content["folders"])).drop("_change")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of keys, read from their buckets only; keys is small: its buckets come to the driver, at most as many as the table has."""
        wanted = [str(r._bucket) for r in keys.select(self._bucket().alias("_bucket")).distinct().collect()]
        return self._alive([b for b in wanted if b in self.content["folders"]]).drop("_change").join(keys.select(*self.key).distinct(), self.key, "left_semi")

    # Changes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.content["n"])).cast("int")

    def put(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Rows come in, or take the place of those with their keys; a column _gone says which only leave. False if the batch was applied already."""
        known = self.content["batch"]
        if batch is not None and known is not None and batch <= known:
            return False
        number = self.version + 1
        if "_gone" not in rows.columns:
            rows = rows.withColumn("_gone", F.lit(False))
        columns = [f.name for f in self.spark.createDataFrame([], self.content["schema"]).schema]
        made = rows.select(*columns, F.lit(number).cast("long").alias("_change"), "_gone")
        one = made.groupBy(*self.key).agg(F.max(F.struct(*[F.col(c) for c in made.columns])).alias("r")).select("r.*")
        touched = self._write(one)
        folders = {b: list(f) for b, f in self.content["folders"].items()}
        for bucket, folder in touched.items():
            folders.setdefault(bucket, []).append(folder)
        self._publish(number, folders, known if batch is None else batch)
        long = [b for b in touched if len(folders[b]) > MOST_CHANGES]
        if long:
            self._merge(long)
        return True

    def drop(self, keys: DataFrame) -> None:
        """Keys leave."""
        others = [f for f in self.spark.createDataFrame([], self.content["schema"]).schema if f.name not in self.key]
        self.put(keys.select(*self.key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in others], F.lit(True).alias("_gone")))

    def evolve(self, schema: str, info: dict | None = None) -> None:
        """Other columns from now on: those that stored rows lack are null, and those that it doesn't name aren't read."""
        self._publish(self.version + 1, self.content["folders"], self.content["batch"], schema, info)

    def _merge(self, buckets: list[str]) -> None:
        rows = self._alive(buckets).withColumn("_gone", F.lit(False))
        made = self._write(rows)
        folders = {b: ([made[b]] if b in made else []) if b in buckets else f for b, f in self.content["folders"].items()}
        self._publish(self.version + 1, {b: f for b, f in folders.items() if f}, self.content["batch"])

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        at = uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", self._bucket()).repartition("_bucket").sortWithinPartitions("_bucket", *self.key)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/data/{at}")
        fs, root = versions.hadoop(self.spark, f"{self.path}/data/{at}")
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return {n.split("=")[1]: f"{at}/{n}" for n in names if n.startswith("_bucket=")}

    def _publish(self, number: int, folders: dict, batch: int | None, schema: str | None = None, info: dict | None = None) -> None:
        content = self.content | {"folders": folders, "batch": batch} | ({"schema": schema} if schema else {}) | ({"info": info} if info is not None else {})
        versions.publish(self.spark, self.path, number, content)
        self.version, self.content = number, content
