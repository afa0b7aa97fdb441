"""Attempts that are leased to workers: claims, heartbeats and sweeps folded from events, as a stream and as a batch.

An attempt of a source in a cycle is queued, claimed by a worker for some seconds, kept alive by heartbeats and finished, given back or swept.
What a worker does counts only while it holds the lease: a claim gives it a generation, and whoever comes with another one, or after the lease ran
out, is refused. A lease ends at its time whether or not anything happens to it then; what comes later finds it abandoned.

The stream keeps events until the watermark passes them, so events that come in any order within the allowed lateness are applied in the order
of their times, and it makes the same log as the batch. Timers wake a source for waiting events, for the end of its lease, and to forget a cycle that
is over. The batch reads sorted partitions row by row; neither holds a source's history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimloom.operators.fleet import SUCCESS

#: Attempts of a source in one cycle.
MOST_ATTEMPTS = 3
#: How long a finished cycle of a source is remembered, in milliseconds of event time.
REMEMBER = 7 * 24 * 3600 * 1000

EVENTS = "source_id long, cycle string, at timestamp, event_id long, kind string, worker string, generation int, seconds int, status string"
LOG = "source_id long, cycle string, at timestamp, event_id long, kind string, worker string, attempt_no int, generation int, result string, state string, status string"
_FIELDS = ("at", "event_id", "kind", "worker", "generation", "seconds", "status")


class Attempt(NamedTuple):
    """The newest attempt of a source in a cycle; times are milliseconds."""

    state: str = "NONE"
    attempt_no: int = 0
    generation: int = 0
    worker: str | None = None
    expires: int = 0


class Event(NamedTuple):
    at: int
    event_id: int
    kind: str
    worker: str | None
    generation: int | None
    seconds: int
    status: str | None


def swept(a: Attempt, now: int) -> tuple[Attempt, tuple | None]:
    """The attempt at a time, and the log entry (at, event_id, kind, worker, attempt_no, generation, result, state, status) of a lease that ran out before it."""
    if a.state != "RUNNING" or a.expires >= now:
        return a, None
    return a._replace(state="ABANDONED", worker=None), (a.expires, None, "SWEEP", a.worker, a.attempt_no, a.generation, "ACCEPTED", "ABANDONED", "ABANDONED")


def applied(a: Attempt, e: Event) -> tuple[Attempt, tuple]:
    """The attempt after an event, and the event's log entry: ACCEPTED, or why not."""
    held = a.state == "RUNNING" and a.worker == e.worker and e.generation in (None, a.generation)
    if e.kind == "QUEUE":
        result = "ALREADY_OPEN" if a.state in ("QUEUED", "RUNNING") else "ATTEMPTS_SPENT" if a.attempt_no >= MOST_ATTEMPTS else "ACCEPTED"
        after = a._replace(state="QUEUED", attempt_no=a.attempt_no + 1, worker=None)
    elif e.kind == "CLAIM":
        result = "ACCEPTED" if a.state == "QUEUED" else "NOTHING_QUEUED"
        after = a._replace(state="RUNNING", generation=a.generation + 1, worker=e.worker, expires=e.at + 1000 * e.seconds)
    elif e.kind == "HEARTBEAT":
        result, after = "ACCEPTED" if held else "LEASE_LOST", a._replace(expires=e.at + 1000 * e.seconds)
    elif e.kind == "RELEASE":
        result, after = "ACCEPTED" if held else "LEASE_LOST", a._replace(state="QUEUED", worker=None)
    elif e.kind == "FINALIZE":
        result, after = "ACCEPTED" if held else "LEASE_LOST", a._replace(state="FINALIZED", worker=None)
    else:
        result, after = "UNKNOWN_KIND", a
    if result != "ACCEPTED":
        after = a
    return after, (e.at, e.event_id, e.kind, e.worker, after.attempt_no, after.generation, result, after.state, e.status)


def folded(a: Attempt, events: Iterator[Event]) -> Iterator[tuple[Attempt, tuple]]:
    """Attempt and log entry after each of the events, which come in order, and after each sweep before them."""
    for e in events:
        a, entry = swept(a, e.at)
        if entry:
            yield a, entry
        a, entry = applied(a, e)
        yield a, entry


def _ms(t) -> int:
    return t.value // 1_000_000 if isinstance(t, pd.Timestamp) else int(t.replace(tzinfo=t.tzinfo or dt.timezone.utc).timestamp() * 1000)


def lease_log(events: DataFrame, until: Column | None = None) -> DataFrame:
    """The log of all events (columns of ``EVENTS``) in a batch: every event with its result, and a SWEEP for every lease that ran out.

    Events of a source and cycle are applied by time (milliseconds) and id; nulls in source, cycle, time or kind make an event none. A lease that is still open
    after the last event is swept if it ran out before ``until`` (by default the newest event of all).
    """
    some = events.filter("source_id is not null and cycle is not null and at is not null and kind is not null").withColumn("at", F.date_trunc("millisecond", "at"))
    end = F.coalesce(until if until is not None else F.lit(None).cast("timestamp"), F.lit(some.agg(F.max("at")).head()[0]).cast("timestamp"))
    rows = some.select("source_id", "cycle", F.unix_millis("at").alias("at"), *_FIELDS[1:5], F.coalesce("seconds", F.lit(0)).alias("seconds"), "status", F.unix_millis(end).alias("end"))
    rows = rows.repartition("source_id", "cycle").sortWithinPartitions("source_id", "cycle", "at", "event_id")
    schema = to_arrow_schema(T.StructType.fromDDL(LOG.replace("at timestamp", "at long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, attempt, end, out = None, Attempt(), 0, []

        def closed() -> list[tuple]:
            entry = swept(attempt, end)[1] if key is not None else None
            return [(*key, *entry)] if entry else []

        for b in batches:
            for source, cycle, *event, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (source, cycle) != key:
                    out += closed()
                    key, attempt = (source, cycle), Attempt()
                end = last
                for attempt, entry in folded(attempt, iter([Event(*event)])):
                    out.append((*key, *entry))
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        out += closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, LOG.replace("at timestamp", "at long")).withColumn("at", F.timestamp_millis("at"))


class _Leases(StatefulProcessor):
    """Per source and cycle: the attempt, and the events that the watermark hasn't passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempt = handle.getValueState("attempt", "state string, attempt_no int, generation int, worker string, expires long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string, worker string, generation int, seconds int, status string")
        self.forget = handle.getValueState("forget", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed, known = timerValues.getCurrentWatermarkInMs(), set(self.handle.listTimers())
        for r in rows:
            e = Event(_ms(r.at), *(getattr(r, f) for f in _FIELDS[1:5]), r.seconds or 0, r.status)
            self.waiting.appendValue(tuple(e))
            # a timer is due when the watermark has passed it
            if (due := max(e.at, passed) + 1) not in known:
                self.handle.registerTimer(due)
                known.add(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        a = Attempt(*self.attempt.get()) if self.attempt.exists() else Attempt()
        events = sorted((Event(*e) for e in self.waiting.get()), key=lambda e: (e.at, e.event_id)) if self.waiting.exists() else []
        due, later = [e for e in events if e.at < passed], [e for e in events if e.at >= passed]
        log = []
        for a, entry in folded(a, iter(due)):
            log.append(entry)
        a, entry = swept(a, passed)
        if entry:
            log.append(entry)
        if due:
            self.waiting.put([tuple(e) for e in later]) if later else self.waiting.clear()
        if log:
            self.attempt.update(tuple(a))
            end = a.expires if a.state == "RUNNING" else passed + REMEMBER
            self.forget.update((end,)) if a.state != "RUNNING" else self.forget.clear()
            self.handle.registerTimer(end + 1)
        elif not later and self.forget.exists() and self.forget.get()[0] < passed:
            self.attempt.clear()
            self.forget.clear()
        for at, *entry in log:
            yield Row(source_id=key[0], cycle=key[1], at=dt.datetime.fromtimestamp(at / 1000, dt.timezone.utc), **dict(zip(("event_id", "kind", "worker", "attempt_no", "generation", "result", "state", "status"), entry, strict=True)))

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """:func:`lease_log` of a stream of events: the same entries for all events that are at most ``late`` behind the newest, once the watermark has passed them.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). A cycle of a source is forgotten a week after its last event.
    """
    some = events.filter("source_id is not null and cycle is not null and at is not null and kind is not null").withColumn("at", F.date_trunc("millisecond", "at")).withWatermark("at", late)
    return some.groupBy("source_id", "cycle").transformWithState(_Leases(), LOG, "append", "eventTime")


# Seconds of pauses, strikes before a person looks, statuses that no retry mends.
RATE_LIMIT_PAUSE, DNS_PAUSE, STRIKES = 900, 300, 4
GONE = (404, 410)


def reactions(outcomes: DataFrame) -> DataFrame:
    """What each finished attempt has as a consequence: ``pause_s`` of its source and ``host_pause_s`` of its host, ``retry_s`` until the next attempt, ``strikes``, ``judgement``.

    ``outcomes``: source_id, run_id, at, attempt_no, status, http_status, retry_after. A rate limit pauses source and host for what the site asked, else 15 minutes; its fourth
    since the last success asks for a review instead of a retry. A name that can't be resolved for now pauses the source 5 minutes at least; one that doesn't exist asks for a
    review; a refusal blocks. Errors and time-outs are tried again after a growing wait (or what the site asked, an hour at most), unless the page is gone; what we
    broke ourselves isn't, nor is what was abandoned. Attempts beyond the third have no retry.
    """
    s, no = F.col("status"), F.col("attempt_no")
    order = Window.partitionBy("source_id").orderBy("at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.count_if(s == "RATE_LIMITED")
    spell = outcomes.withColumn("spell", F.count_if(s.isin(*SUCCESS)).over(order))
    strikes = hit.over(Window.partitionBy("source_id", "spell").orderBy("at", "run_id").rowsBetween(Window.unboundedPreceding, 0))
    asked = F.col("retry_after").cast("double")
    grows = F.least(F.lit(300.0), F.lit(15.0) * F.pow(F.lit(2.0), F.greatest(no - 1, F.lit(0))))
    wait = F.when(asked.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(3600.0), asked))).otherwise(grows)
    limited, dns, again = s == "RATE_LIMITED", s == "DNS_TEMPORARY", s.isin("HTTP_ERROR", "TIMEOUT") & ~F.coalesce(F.col("http_status").isin(*GONE), F.lit(False))
    pause = F.when(limited, F.coalesce(F.when(asked != 0, asked), F.lit(float(RATE_LIMIT_PAUSE)))).when(dns, F.greatest(F.lit(float(DNS_PAUSE)), grows))
    spent = no >= MOST_ATTEMPTS
    tired = limited & (F.col("strikes") >= STRIKES)
    return spell.withColumn("strikes", F.when(s.isin(*SUCCESS), 0).otherwise(strikes).cast("int")).select(
        "source_id", "run_id", "at", "status", pause.alias("pause_s"), F.when(limited, pause).alias("host_pause_s"),
        F.when(~spent & ~tired & (limited | dns), pause).when(~spent & again, wait).alias("retry_s"), "strikes",
        F.when(tired | (s == "NAME_NOT_RESOLVED"), "NEEDS_MANUAL_REVIEW").when(s == "BLOCKED", "BLOCKED").when(s.isin(*SUCCESS), "CLEARED").alias("judgement"),
    )


def standings(reactions: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source what its reactions leave (``cooldown_until``, ``eligibility``, ``strikes``), and per host until when it is paused.

    A pause is cleared by a later success; otherwise the latest one set holds. A judgement is made while none stands, so the first one stays. A host's pause only ever extends. ``hosts``: source_id, host.
    """
    last = lambda c, when: F.max(F.when(when, F.struct("at", "run_id", c)))
    until = F.timestamp_millis(F.unix_millis("at") + (F.col("pause_s") * 1000).cast("long"))
    r = reactions.withColumns({"until": until, "host_until": F.when(F.col("host_pause_s").isNotNull(), until)})
    moved = F.col("pause_s").isNotNull() | (F.col("judgement") == "CLEARED")
    judged = F.col("judgement").isin("BLOCKED", "NEEDS_MANUAL_REVIEW")
    per = r.groupBy("source_id").agg(last("until", moved).alias("u"), F.min(F.when(judged, F.struct("at", "run_id", "judgement"))).alias("j"), F.max(F.struct("at", "run_id", "strikes")).alias("s"))
    sources = per.select("source_id", F.col("u.until").alias("cooldown_until"), F.coalesce("j.judgement", F.lit("FETCHABLE")).alias("eligibility"), F.col("s.strikes").alias("strikes"))
    return sources, r.filter("host_until is not null").join(hosts, "source_id").groupBy("host").agg(F.max("host_until").alias("paused_until"))
