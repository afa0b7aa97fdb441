"""Numbers for all rows of an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import scratch

#: Rows of a range, about, and ranges at most; beyond them ranges hold more rows, which are sorted with spilling.
RANGE_ROWS, RANGES = 100_000, 20_000


def numbered(rows: DataFrame, order: list[Column], name: str = "number", per_range: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with their place in the order, from 1. ``order`` must tell all rows apart, or else equal rows are numbered in any order.

    Rows are dealt to ranges of the order and counted there; a range's numbers begin behind those of the ranges before it. One task sees one row a range.
    """
    spark = rows.sparkSession
    count = rows.count()
    path = scratch(spark, "numbering")
    dealt = rows.repartitionByRange(max(1, min(RANGES, -(-count // per_range))), *order).withColumn("__range", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__here", here).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__before") + F.col("__here")).cast("long")).drop("__range", "__before", "__here")


def official_sources(cells: DataFrame, per_range: int = RANGE_ROWS) -> DataFrame:
    """References for the addresses of a workbook: ``source_ref`` (S and four digits or more) in the order of row and column (cells of one place by institution and address, nulls first), and ``duplicate_of``.

    ``cells``: row, column, institution, url_hash (a cell each; those without an address are left out). The first reference of an institution's address is physical; later ones name
    it as what they repeat. The same address of another institution is its own.
    """
    n = numbered(cells.filter("url_hash is not null"), [F.col(c).asc_nulls_first() for c in ("row", "column", "institution", "url_hash")], "number", per_range)
    ref = lambda c: F.concat(F.lit("S"), F.when(c < 10_000, F.lpad(c.cast("string"), 4, "0")).otherwise(c.cast("string")))
    first = n.groupBy("institution", "url_hash").agg(F.min("number").alias("first")).withColumnsRenamed({"institution": "__i", "url_hash": "__u"})
    j = n.join(first, n["institution"].eqNullSafe(F.col("__i")) & (n["url_hash"] == F.col("__u")))
    return j.select(ref(F.col("number")).alias("source_ref"), "row", "column", "institution", "url_hash", F.when(F.col("first") < F.col("number"), ref(F.col("first"))).alias("duplicate_of"))
