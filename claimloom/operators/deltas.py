"""Derived tables kept up to date from changes: signed rows, joins of changes, counts that a withdrawal undoes.

A change is a table of rows with a weight ``w``: 1 for a row that came, -1 for one that went; a row that is changed is one of each. A
join's change follows from the changes of its sides and their rows at the changed keys; a count's from the sum of weights, so a key stays as long as any row
supports it. Only keys that a change touches are read: tables that :class:`Buckets` keeps are read by the buckets of these keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signed(rows: DataFrame, w: int = 1) -> DataFrame:
    return rows.withColumn("w", F.lit(w).cast("long"))


def consolidated(change: DataFrame) -> DataFrame:
    """The change with one row for all that are equal; what came and went alike is left out."""
    columns = [c for c in change.columns if c != "w"]
    return change.groupBy(*columns).agg(F.sum("w").alias("w")).filter("w <> 0")


def join_change(left: DataFrame, right: DataFrame, left_change: DataFrame, right_change: DataFrame, keys: list[str]) -> DataFrame:
    """Change of the join of ``left`` and ``right`` (as they were) on ``keys``, from the changes of both; nulls join nothing."""

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.withColumnRenamed("w", "__w"), keys).withColumn("w", F.col("w") * F.col("__w")).drop("__w")

    old_left = signed(left.join(right_change.select(*keys).distinct(), keys, "left_semi"))
    old_right = signed(right.join(left_change.select(*keys).distinct(), keys, "left_semi"))
    parts = [product(left_change, old_right), product(old_left, right_change), product(left_change, right_change)]
    columns = parts[0].columns
    return consolidated(parts[0].unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns)))


def count_change(counts: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows changes, with the number ``before`` and ``after``. ``counts``: keys and ``n`` as they were, without keys that have none."""
    moved = change.groupBy(*keys).agg(F.sum("w").alias("__d")).filter("__d <> 0")
    return moved.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("before"), (F.coalesce("n", F.lit(0)) + F.col("__d")).alias("after"))


def turned(change: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a change of counts brings in (weight 1) or takes away (-1)."""
    w = F.when((F.col("before") <= 0) & (F.col("after") > 0), 1).when((F.col("before") > 0) & (F.col("after") <= 0), -1)
    return change.select(*keys, w.cast("long").alias("w")).filter("w is not null")


class Buckets:
    """Tables under ``path``, each in buckets of a key, so that a change reads and rewrites the buckets of its keys alone."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.versions: dict[str, dict[int, int]] = {}
        self.keys: dict[str, list[str]] = {}
        self.schemas: dict[str, T.StructType] = {}

    def kept(self, change: DataFrame) -> DataFrame:
        """The change written once beside the tables, so that what is read from it doesn't compute it again."""
        path = f"{self.path}/changes/{uuid.uuid4().hex}"
        change.write.parquet(path)
        return self.spark.read.schema(change.schema).parquet(path)

    def _bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def create(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Write a table, a folder a bucket. ``versions`` holds which version of a bucket counts; it has one small number a bucket."""
        self.keys[name], self.versions[name], self.schemas[name] = keys, dict.fromkeys(range(self.buckets), 0), rows.schema
        rows.withColumn("bucket", self._bucket(keys)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/version=0")

    def _read(self, name: str, buckets: list[int]) -> DataFrame:
        by_version: dict[int, list[int]] = {}
        for b in buckets:
            by_version.setdefault(self.versions[name][b], []).append(b)
        out = self.spark.createDataFrame([], self.schemas[name])
        for version, some in by_version.items():
            # the buckets' folders alone are read
            rows = self.spark.read.schema(T.StructType([*self.schemas[name].fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{name}/version={version}")
            out = out.unionByName(rows.filter(F.col("bucket").isin(some)).drop("bucket"))
        return out

    def table(self, name: str) -> DataFrame:
        return self._read(name, list(range(self.buckets)))

    def touched(self, name: str, change: DataFrame) -> list[int]:
        """Buckets of the changed keys; at most ``buckets`` numbers."""
        return sorted(r[0] for r in change.select(self._bucket(self.keys[name])).distinct().collect())

    def at(self, name: str, change: DataFrame) -> DataFrame:
        """The rows of the buckets that the change's keys lie in."""
        return self._read(name, self.touched(name, change))

    def apply(self, name: str, change: DataFrame) -> int:
        """Rewrite the touched buckets with the change applied, as a new version beside the old one; the number of buckets."""
        some = self.touched(name, change)
        if not some:
            return 0
        version = 1 + max(self.versions[name].values())
        columns = self.schemas[name].names
        rows = consolidated(signed(self._read(name, some)).unionByName(change.select(*columns, "w")))
        rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.greatest("w", F.lit(0)).cast("int")))).select(*columns)
        rows.withColumn("bucket", self._bucket(self.keys[name])).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")
        self.versions[name] |= dict.fromkeys(some, version)
        return len(some)

    def set_counts(self, name: str, change: DataFrame) -> int:
        """Rewrite counts (keys and ``n``) with a change of :func:`count_change`."""
        keys = [c for c in change.columns if c not in ("before", "after")]
        went = change.filter("before <> 0").select(*keys, F.col("before").alias("n"), F.lit(-1).cast("long").alias("w"))
        came = change.filter("after <> 0").select(*keys, F.col("after").alias("n"), F.lit(1).cast("long").alias("w"))
        return self.apply(name, went.unionByName(came))
