"""State of fetched sources from their run history: health, schedule, evidence, access, retries and the work queue.

Runs have ``source_id``, ``run_id``, ``started_at``, ``status``, ``http_status`` and ``error_class``. What is
"latest" is an aggregate (the greatest of time and id), never a window over a source's
history, so a source with very many runs is added up map-side like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a run that reached the page, and of one that may succeed when tried again.
SUCCESS = ("OK", "UNCHANGED")
TEMPORARY = ("RATE_LIMITED", "DNS_TEMPORARY")
RETRYABLE = ("TIMEOUT", "RATE_LIMITED", "DNS_TEMPORARY", "HTTP_ERROR")


def newest(runs: DataFrame, *names: str, when: Column | None = None) -> DataFrame:
    """Per source the columns ``names`` of its newest run (by time, then id; no time is oldest), among those ``when`` holds for."""
    whole = F.struct("started_at", "run_id", *[F.col(n).alias(f"_{i}") for i, n in enumerate(names)])
    top = runs.groupBy("source_id").agg(F.max(F.when(when, whole) if when is not None else whole).alias("top"))
    return top.filter("top is not null").select("source_id", F.col("top.started_at").alias("at"), F.col("top.run_id").alias("id"), *[F.col(f"top._{i}").alias(n) for i, n in enumerate(names)])


def since(runs: DataFrame, marks: DataFrame, counted: Column, name: str) -> DataFrame:
    """Per source the number of ``counted`` runs newer than its row (at, id) in ``marks``; all of them where it has none."""
    m = marks.select("source_id", F.struct(F.col("at").alias("started_at"), F.col("id").alias("run_id")).alias("mark"))
    later = runs.join(m, "source_id", "left").filter(F.col("mark").isNull() | (F.struct("started_at", "run_id") > F.col("mark")))
    return later.groupBy("source_id").agg(F.count(F.when(counted, 1)).alias(name))


def source_status(sources: DataFrame, runs: DataFrame, snapshots: DataFrame, host_cooldowns: DataFrame, as_of: Column, stale_after: Column) -> DataFrame:
    """Per source: last run, failures since its last success, last content, ``health`` and ``schedule_state``.

    The first rule that fits names the state. Sources without a run are kept.
    """
    good = F.col("status").isin(*SUCCESS)
    latest = newest(runs, "status", "http_status", "error_class").withColumnsRenamed({"at": "last_attempt_at", "status": "last_status", "http_status": "last_http_status", "error_class": "last_error_class"}).drop("id")
    success = newest(runs, when=good)
    failures = since(runs, success, F.lit(True), "consecutive_failures")
    content = snapshots.groupBy("source_id").agg(F.max(F.struct("observed_at", "snapshot_id", "content_hash")).alias("c")).select("source_id", F.col("c.content_hash").alias("last_content_hash"), F.col("c.observed_at").alias("last_content_at"))
    total = runs.groupBy("source_id").agg(F.count("*").alias("total_runs"))
    s = sources
    for side in (total, latest, failures, success.select("source_id", F.col("at").alias("last_success_at")), content):
        s = s.join(side, "source_id", "left")
    s = s.join(host_cooldowns.withColumnRenamed("cooldown_until", "host_cooldown_until"), "host", "left").fillna(0, ["total_runs", "consecutive_failures"])
    fixed = (
        F.when(~F.col("is_active") | (F.col("fetch_eligibility") == "DISABLED"), "DISABLED").when(F.col("fetch_eligibility") == "NEEDS_MANUAL_REVIEW", "NEEDS_MANUAL_REVIEW")
        .when((F.col("fetch_eligibility") == "BLOCKED") | (F.col("access_state") != "OK"), "BLOCKED")
    )
    waits = lambda c: F.coalesce(F.col(c) > as_of, F.lit(False))
    health = (
        F.when(F.col("last_status").isNull(), "NEVER_FETCHED").when(F.col("last_status").isin(*TEMPORARY) | waits("cooldown_until"), "DEGRADED")
        .when(F.col("consecutive_failures") >= 3, "FAILING").when(F.col("consecutive_failures") >= 1, "DEGRADED").when(F.col("last_success_at") < as_of - stale_after, "STALE").otherwise("HEALTHY")
    )
    schedule = F.when(waits("cooldown_until") | waits("host_cooldown_until"), "COOLDOWN").otherwise("FETCHABLE_NOW")
    return s.withColumns({"health": F.coalesce(fixed, health), "schedule_state": F.coalesce(fixed, schedule)})


def effective_evidence(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per source with a success: the body its newest success stands for, when it was confirmed and by how many 304s since the last body.

    A run that found the page unchanged names the content it confirms; without a name the newest snapshot counts.
    """
    latest = newest(runs, "status", "unchanged_content_hash", when=F.col("status").isin(*SUCCESS)).withColumnRenamed("at", "confirmed_at").drop("id")
    streak = since(runs, newest(runs, when=F.col("status") == "OK"), F.col("status") == "UNCHANGED", "unchanged_runs")
    s = snapshots.join(latest.select("source_id", "unchanged_content_hash"), "source_id").filter(F.coalesce(F.col("content_hash") == F.col("unchanged_content_hash"), F.col("unchanged_content_hash").isNull()))
    body = s.groupBy("source_id").agg(F.max(F.struct("observed_at", "snapshot_id", "content_hash")).alias("b")).select("source_id", "b.snapshot_id", "b.content_hash", "b.observed_at")
    return latest.join(body, "source_id", "left").join(streak, "source_id", "left").select("source_id", "snapshot_id", "content_hash", "observed_at", F.col("status").alias("latest_status"), "confirmed_at", F.coalesce("unchanged_runs", F.lit(0)).alias("unchanged_runs"))


def access_class(has_evidence: Column, status: Column, http_status: Column, error: Column) -> Column:
    """Why a page's body is or isn't at hand, the first reason that fits."""
    e = F.upper(F.coalesce(error, F.lit("")))
    return (
        F.when(has_evidence, "BODY_EVIDENCE").when(status == "BLOCKED", "BLOCKED").when(status == "NAME_NOT_RESOLVED", "DEAD_HOST").when(status == "TIMEOUT", "TIMEOUT")
        .when(F.coalesce(status, F.lit("")) == "", "NO_ATTEMPT").when(http_status.isin(404, 410), "DEAD_NOT_FOUND").when(e.rlike("TLS|SSL|CERT"), "TLS_FAILURE").otherwise("OTHER_HTTP")
    )


def followup(status: Column, http_status: Column, error: Column, schedule_state: Column) -> Column:
    """The one follow-up of a failing page."""
    return (
        F.when(status.isNull(), "NOT_YET_ATTEMPTED").when(http_status.isin(404, 410), "DEAD_URL").when(status == "BLOCKED", "BLOCKED_ACCESS")
        .when((schedule_state == "COOLDOWN") | (status == "RATE_LIMITED"), "RETRY_AFTER_COOLDOWN").when(F.contains(F.coalesce(error, F.lit("")), F.lit("CERTIFICATE_VERIFY_FAILED")), "TLS_CHAIN_FAILURE")
        .when(status == "NAME_NOT_RESOLVED", "NAME_NOT_RESOLVED").when(status.isin("TIMEOUT", "DNS_TEMPORARY"), "TEMPORARY_NETWORK_FAILURE").when(status == "INTERNAL_ERROR", "INTERNAL_ERROR")
        .when(http_status.isNotNull(), "UNEXPECTED_HTTP_STATUS").otherwise("SOURCE_REVIEW_OTHER")
    )


def strikes(runs: DataFrame, most: int = 4) -> DataFrame:
    """Per source its rate-limit strikes since the last success, ``most`` at most, and whether that pauses its host."""
    s = since(runs, newest(runs, when=F.col("status").isin(*SUCCESS)), F.col("status") == "RATE_LIMITED", "n")
    n = F.least(F.col("n"), F.lit(most)).cast("int")
    return s.select("source_id", n.alias("strikes"), (n >= most).alias("host_paused"))


def expired(attempts: DataFrame, as_of: Column) -> DataFrame:
    """Running attempts whose lease has run out: they are abandoned, one run each."""
    return attempts.filter((F.col("state") == "RUNNING") & (F.col("lease_expires_at") < as_of)).select("attempt_id", "source_id", "attempt_no", F.lit("ABANDONED").alias("status"), F.col("lease_expires_at").alias("finished_at"))


def retries(attempts: DataFrame, runs: DataFrame, most: int = 3) -> DataFrame:
    """The next attempt of each source whose newest run may succeed when tried again: number one above the highest, ``most`` at most, none while one is open."""
    a = attempts.groupBy("source_id").agg(F.max("attempt_no").alias("n"), F.max(F.col("state").isin("QUEUED", "RUNNING")).alias("open"))
    latest = newest(runs, "status").filter(F.col("status").isin(*RETRYABLE))
    return a.filter((F.col("n") < most) & ~F.col("open")).join(latest, "source_id").select("source_id", (F.col("n") + 1).alias("attempt_no"), "status")


def enqueue_decisions(status: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a new cycle does with each source: ENQUEUED, or the first reason why not."""
    busy = attempts.filter(F.col("state").isin("QUEUED", "RUNNING")).select("source_id", F.lit(True).alias("busy")).distinct()
    s = status.join(busy, "source_id", "left")
    why = F.when(F.col("schedule_state") == "COOLDOWN", "COOLDOWN").when(F.col("schedule_state") != "FETCHABLE_NOW", "NOT_FETCHABLE").when(F.col("busy"), "ALREADY_QUEUED").otherwise("ENQUEUED")
    return s.select("source_id", why.alias("decision"))


def claimable(attempts: DataFrame, sources: DataFrame, host_cooldowns: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The ``limit`` queued attempts to hand out next: none whose host waits, those without a time first, then by time and id."""
    waiting = host_cooldowns.filter(F.col("cooldown_until") > as_of).select("host")
    q = attempts.filter(F.col("state") == "QUEUED").join(sources.select("source_id", "host"), "source_id").join(waiting, "host", "left_anti")
    return q.orderBy(F.col("scheduled_for").asc_nulls_first(), "attempt_id").limit(limit).select("attempt_id", "source_id", "host", "scheduled_for")
