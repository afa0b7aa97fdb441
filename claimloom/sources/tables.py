"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task for work that is heavy beside the bytes that hold a row, and such tasks at most (beyond that they get more rows).
ROWS_PER_TASK, TASKS = 5_000, 20_000


def spread(rows: DataFrame, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` dealt out evenly to as many tasks as their number needs: a file is read by as many as its bytes need, which can be a single one for a million rows."""
    return rows.repartition(max(1, min(TASKS, -(-rows.count() // per_task))))


def append_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``existing`` lacks, the least row of each key: an idempotent insert's delta."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, "row.*") if rest else new.distinct()
    return one.join(existing.select(*keys), keys, "left_anti").select(*new.columns)
