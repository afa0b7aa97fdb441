"""Discrete percentiles of groups of any size, by narrowing brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import scratch

#: Relative error of a bracket's ends, as its inverse, and distinct values of a bracket that are ranked one by one.
ACCURACY, RANKED = 1_000, 100_000


def percentile_disc(rows: DataFrame, group: str, value: str, p: float, accuracy: int = ACCURACY, ranked: int = RANKED) -> DataFrame:
    """``group`` and the least ``value`` whose share of the group's values up to it is at least ``p``; null values don't count, a group without any has null.

    A sketch of bounded size gives every group two values that surely lie on both sides of the one that is looked for. What lies below
    is counted, what lies between stays; that is repeated until few different values are left of each group, and these are ranked. No task holds a
    group's values, whatever their number.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must lie between 0 and 1")
    spark = rows.sparkSession
    r = rows.select(F.col(group).alias("__g"), F.col(value).alias("__v"))
    groups = r.select("__g").distinct()
    r = r.filter("__v is not null")
    # place of the wanted value among the sorted ones, from 1, and how many lie below what is left
    left = r.groupBy("__g").agg(F.count("*").alias("n")).select("__g", "n", F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).alias("place"), F.lit(0).cast("long").alias("below"))
    while True:
        path = scratch(spark, "percentile")
        left.write.mode("overwrite").parquet(path)
        left = spark.read.schema(left.schema).parquet(path)
        counted = r.groupBy("__g", "__v").agg(F.count("*").alias("c"))
        most = counted.groupBy("__g").count().agg(F.max("count")).head()[0] or 0
        if most <= ranked:
            break
        inside = r.groupBy("__g").agg(F.count("*").alias("inside")).join(left, r["__g"].eqNullSafe(left["__g"])).drop(left["__g"])
        sketch = r.groupBy("__g").agg(F.approx_percentile("__v", [k / accuracy for k in range(accuracy + 1)], accuracy * 10).alias("q"))
        # a quantile of the sketch may be off by a tenth of a step; one and a half steps on either side are safe
        share = (F.col("place") - F.col("below")) / F.col("inside")
        at = lambda x: F.greatest(F.lit(0), F.least(F.lit(accuracy), x)).cast("int")
        b = sketch.join(inside, sketch["__g"].eqNullSafe(inside["__g"])).drop(inside["__g"])
        b = b.select("__g", F.get("q", at(F.floor(share * accuracy) - 2)).alias("low"), F.get("q", at(F.ceil(share * accuracy) + 2)).alias("high"), "n", "place", "below", (F.floor(share * accuracy) - 2 <= 0).alias("least"), (F.ceil(share * accuracy) + 2 >= accuracy).alias("greatest"))
        path = scratch(spark, "percentile")
        b.write.mode("overwrite").parquet(path)
        b = spark.read.schema(b.schema).parquet(path)
        j = r.join(b.withColumnRenamed("__g", "bg"), r["__g"].eqNullSafe(F.col("bg")))
        under = ~F.col("least") & (F.col("__v") < F.col("low"))
        kept = j.filter(~under & (F.col("greatest") | (F.col("__v") <= F.col("high")))).select("__g", "__v")
        dropped = j.filter(under).groupBy("__g").agg(F.count("*").alias("d"))
        left = b.select("__g", "n", "place", "below").join(dropped.withColumnRenamed("__g", "dg"), F.col("__g").eqNullSafe(F.col("dg")), "left").select("__g", "n", "place", (F.col("below") + F.coalesce("d", F.lit(0))).alias("below"))
        before, r = r, kept
        path = scratch(spark, "percentile")
        r.write.mode("overwrite").parquet(path)
        r = spark.read.schema(before.schema).parquet(path)
    upto = F.sum("c").over(Window.partitionBy("__g").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    c = counted.withColumn("upto", upto).join(left.withColumnRenamed("__g", "lg"), counted["__g"].eqNullSafe(F.col("lg")))
    found = c.filter(F.col("upto") + F.col("below") >= F.col("place")).groupBy("__g").agg(F.min("__v").alias(value))
    return groups.withColumnRenamed("__g", group).join(found, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, value)
