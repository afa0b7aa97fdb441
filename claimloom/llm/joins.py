"""Joins by keys that may have a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No key's rows are dealt to fewer tasks than its share of this number, rounded up.
SHARE = 1000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner", sizes: DataFrame | None = None, total: int | None = None, share: int = SHARE) -> DataFrame:
    """``left`` joined with ``right`` (one row per key) on ``keys``; keys with more than a ``share``-th of the rows are dealt to several tasks.

    There are fewer than ``share`` such keys, so they can be broadcast, and ``right`` gets at most twice ``share`` more rows. ``by``: what
    deals the rows of such a key, and rows with a null in their key; it must be the same whenever a task is repeated. ``sizes``: rows per key (column
    ``n``) if known, with the ``total``; else ``left`` is counted. ``how``: inner, left, left_semi or left_anti.
    """
    if sizes is None:
        sizes, total = left.groupBy(*keys).agg(F.count("*").alias("n")), left.count()
    often = sizes.filter(F.col("n") * share > F.lit(total)).select(*keys, F.ceil(F.col("n") * share / F.lit(max(1, total or 0))).cast("int").alias("__copies"))
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.when(some_null, F.pmod(by, F.lit(share))).when(F.col("__copies").isNotNull(), F.pmod(by, F.col("__copies"))).otherwise(F.lit(0))
    l = left.join(F.broadcast(often), keys, "left").withColumn("__salt", salt.cast("int")).drop("__copies")
    r = right.join(F.broadcast(often), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    return l.join(r, [*keys, "__salt"], how).drop("__salt")
