"""Manifests: round trips, failed tasks, changed bytes."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import pytest
from pyspark.sql import functions as F

from claimloom.sources import manifests


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(manifests.ManifestSource)


def rows(spark, n=500):
    return spark.range(n).select(
        "id", F.concat(F.lit("é\n\"x\" "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("d"), F.array(F.lit(1), F.lit(None).cast("int")).alias("a"), F.struct((F.col("id") % 2 == 0).alias("b")).alias("s"),
        F.lit(dt.date(2024, 1, 2)).alias("day"), F.lit(decimal.Decimal("1.50")).alias("price"),
    )


def test_round_trip_and_digests_without_order(spark, tmp_path):
    df, a, b = rows(spark), str(tmp_path / "a"), f"file://{tmp_path}/b"
    df.repartition(5).write.format("manifest").mode("overwrite").save(a)
    df.orderBy(F.desc("id")).coalesce(2).write.format("manifest").mode("overwrite").save(b)
    back = spark.read.format("manifest").load(a)
    assert back.schema == df.schema or [f.dataType for f in back.schema] == [f.dataType for f in df.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    one, two = manifests.manifest(a), manifests.manifest(b)
    assert one["digest"] == two["digest"] and one["rows"] == two["rows"] == 500 and len(one["parts"]) != len(two["parts"])
    assert back.rdd.getNumPartitions() == len(one["parts"])


def test_append_adds_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "m")
    rows(spark, 10).write.format("manifest").mode("append").save(path)
    rows(spark, 5).write.format("manifest").mode("append").save(path)
    assert spark.read.format("manifest").load(path).count() == 15
    rows(spark, 3).write.format("manifest").mode("overwrite").save(path)
    assert spark.read.format("manifest").load(path).count() == 3
    named = {p["name"] for p in manifests.manifest(path)["parts"]}
    assert {f for f in os.listdir(path) if f.startswith("part-")} == named
    rows(spark, 0).write.format("manifest").mode("overwrite").save(path)
    assert spark.read.format("manifest").load(path).count() == 0


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "m")
    rows(spark, 20).write.format("manifest").mode("overwrite").save(path)
    before, there = manifests.manifest(path), set(os.listdir(path))
    bad = rows(spark, 400).repartition(4).withColumn("text", F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("manifest").mode("append").save(path)
    assert manifests.manifest(path) == before and set(os.listdir(path)) >= there
    assert spark.read.format("manifest").load(path).count() == 20
    manifests.vacuum(path)
    assert set(os.listdir(path)) == there and manifests.vacuum(path) == 0


def test_a_changed_byte_and_a_missing_part_are_found(spark, tmp_path):
    path = str(tmp_path / "m")
    rows(spark, 60).repartition(3).write.format("manifest").mode("overwrite").save(path)
    part = f"{path}/{manifests.manifest(path)['parts'][0]['name']}"
    body = open(part, "rb").read()
    with open(part, "wb") as f:
        f.write(body.replace(b"x", b"y", 1))
    with pytest.raises(Exception, match="isn't what the manifest says"):
        spark.read.format("manifest").load(path).collect()
    os.remove(part)
    with pytest.raises(Exception, match="(?i)no such file|not found|failed to open"):
        spark.read.format("manifest").load(path).collect()
