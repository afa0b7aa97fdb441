"""Fetch-run history per source: recency, streaks, health, summaries and samples.

A run has ``source_id``, ``run_id``, ``started_at``, ``outcome`` and ``seconds``; all windows are
partitioned by source, so no operator orders the whole history in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.percentiles import percentile_disc

#: Fixed value: which event types stand for which outcomes in the fixture.
OUTCOMES = {"purchase": "OK", "view": "OK", "signup": "UNCHANGED", "error": "HTTP_ERROR", "click": "BLOCKED"}


def runs_from_events(events: DataFrame) -> DataFrame:
    outcome = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])[F.col("event_type")]
    return events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), outcome.alias("outcome"), F.col("value").alias("seconds"))


def recent_first() -> "Window":
    return Window.partitionBy("source_id").orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc())


def source_health(runs: DataFrame) -> DataFrame:
    """Per source: last outcome, failures since the last success, unchanged runs since the last new body, and a state."""
    good = F.col("outcome").isin("OK", "UNCHANGED")
    r = runs.withColumn("recency", F.row_number().over(recent_first())).withColumn(
        "successes", F.sum(F.when(good, 1).otherwise(0)).over(recent_first().rowsBetween(Window.unboundedPreceding, 0)))
    first_ok = F.min(F.when(F.col("outcome") == "OK", F.col("recency")))
    h = r.groupBy("source_id").agg(
        F.max(F.when(F.col("recency") == 1, F.col("outcome"))).alias("last_outcome"),
        F.count(F.when(F.col("successes") == 0, 1)).alias("failure_streak"),
        (F.coalesce(first_ok, F.count("*").cast("int") + 1) - 1).cast("long").alias("since_new_body"),
        F.max(F.when(good, F.col("started_at"))).alias("last_success"),
        F.count("*").alias("runs"),
    )
    state = (
        F.when(F.col("last_success").isNull(), "NEVER_SUCCEEDED").when(F.col("failure_streak") >= 3, "FAILING")
        .when(F.col("failure_streak") > 0, "DEGRADED").otherwise("HEALTHY")
    )
    return h.withColumn("state", state)


def outcome_summary(runs: DataFrame) -> DataFrame:
    """Counts, distinct sources, mean and discrete median seconds per outcome, most frequent first."""
    sums = runs.groupBy("outcome").agg(
        F.count("*").alias("runs"), F.countDistinct("source_id").alias("sources"), F.round(F.avg("seconds"), 4).alias("mean_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"),
    )
    median = percentile_disc(runs, "outcome", "seconds", 0.5).select(F.col("outcome").alias("o"), F.col("seconds").alias("median_s"))
    return sums.join(median, sums["outcome"].eqNullSafe(F.col("o"))).drop("o").orderBy(F.desc("runs"), "outcome")


def latest_run(runs: DataFrame) -> DataFrame:
    """The latest run of each source beside the number of its runs."""
    n = F.count("*").over(Window.partitionBy("source_id"))
    r = runs.withColumn("nth", F.row_number().over(recent_first())).withColumn("run_count", n)
    return r.filter("nth = 1").select("source_id", "run_id", "outcome", "run_count")


def outcome_variety(runs: DataFrame) -> DataFrame:
    """How many sources had 1, 2, 3 … different outcomes."""
    per = runs.groupBy("source_id").agg(F.countDistinct("outcome").alias("kinds"))
    return per.groupBy("kinds").agg(F.count("*").alias("sources"))


def outcome_lists(runs: DataFrame) -> DataFrame:
    """Per source its distinct outcomes in order, as text, and its upper-median seconds (from counts of equal values, so no list of all is made)."""
    counts = runs.filter("seconds is not null").groupBy("source_id", "seconds").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source_id")
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    median = counts.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("source_id").agg(F.min("seconds").alias("upper_median_s"))
    return runs.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ", ").alias("outcomes")).join(median, "source_id", "left")


def slowest(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("seconds"), "run_id").limit(n).select("run_id", "source_id", "seconds")


def stratified_sample(runs: DataFrame, limit: int = 60) -> DataFrame:
    """By outcome a quota of ``limit`` in proportion to its size (at least 1, halves to the even number), by run id; no more than a sixth of the quota, or 2, of a source.

    Runs are ranked in buckets first and only each bucket's first ``limit`` are ranked together, so no task orders an outcome's history.
    """
    sizes = runs.groupBy("outcome").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    quota = sizes.crossJoin(F.broadcast(total)).select("outcome", F.greatest(F.lit(1.0), F.bround(F.lit(limit) * F.col("n") / F.col("total"))).cast("int").alias("quota"))
    capped = runs.join(F.broadcast(quota), "outcome").withColumn("nth", F.row_number().over(Window.partitionBy("outcome", "source_id").orderBy("run_id")))
    capped = capped.filter(F.col("nth") <= F.greatest(F.lit(2), F.floor(F.col("quota") / 6))).withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(64)))
    first = capped.withColumn("place", F.row_number().over(Window.partitionBy("outcome", "bucket").orderBy("run_id"))).filter("place <= quota")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("outcome").orderBy("run_id"))).filter("place <= quota").select("outcome", "source_id", "run_id")


def cycle_counts(runs: DataFrame) -> DataFrame:
    """Runs by hour of the scheduler's zone."""
    key = F.date_format(F.from_utc_timestamp("started_at", "Asia/Shanghai"), "yyyy-MM-dd'T'HH")
    return runs.groupBy(key.alias("cycle")).agg(F.count("*").alias("runs"))


def retry_waits(runs: DataFrame) -> DataFrame:
    """Seconds to wait after each source's failures since its last success (none: sources left out)."""
    from claimloom.functions.urls import backoff_seconds

    h = source_health(runs).filter("failure_streak > 0")
    return h.select("source_id", "failure_streak", backoff_seconds(F.col("failure_streak"), F.lit(None).cast("int")).alias("wait_s"))
