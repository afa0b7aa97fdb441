"""Leases as a stream and as a batch, reactions to outcomes, and the recorder of fetches."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimloom.streaming import leases, recording

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
at = lambda s: T0 + dt.timedelta(seconds=s)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def events(spark, rows):
    return spark.createDataFrame(rows, leases.EVENTS)


def log_of(spark, rows, until=None):
    log = leases.lease_log(events(spark, rows), until)
    return [(r.event_id, r.kind, r.worker, r.attempt_no, r.generation, r.result, r.state) for r in log.orderBy("source_id", "cycle", "at", F.col("event_id").asc_nulls_first()).collect()]


def test_who_lost_a_lease_is_refused(spark):
    got = log_of(spark, [
        (1, "c", at(0), 1, "QUEUE", None, None, None, None), (1, "c", at(1), 2, "CLAIM", "a", None, 10, None), (1, "c", at(2), 3, "CLAIM", "b", None, 10, None), (1, "c", at(5), 4, "HEARTBEAT", "a", 1, 10, None),
        (1, "c", at(16), 5, "RELEASE", "a", 1, None, None), (1, "c", at(17), 6, "QUEUE", None, None, None, None), (1, "c", at(18), 7, "CLAIM", "b", None, 10, None), (1, "c", at(19), 8, "FINALIZE", "a", 1, None, "OK"),
        (1, "c", at(19), 9, "FINALIZE", "b", 1, None, "OK"), (1, "c", at(28), 10, "FINALIZE", "b", 2, None, "OK"), (1, "c", at(29), 11, "RELEASE", "b", 2, None, None),
    ])
    assert got == [
        (1, "QUEUE", None, 1, 0, "ACCEPTED", "QUEUED"), (2, "CLAIM", "a", 1, 1, "ACCEPTED", "RUNNING"), (3, "CLAIM", "b", 1, 1, "NOTHING_QUEUED", "RUNNING"), (4, "HEARTBEAT", "a", 1, 1, "ACCEPTED", "RUNNING"),
        (None, "SWEEP", "a", 1, 1, "ACCEPTED", "ABANDONED"), (5, "RELEASE", "a", 1, 1, "LEASE_LOST", "ABANDONED"), (6, "QUEUE", None, 2, 1, "ACCEPTED", "QUEUED"), (7, "CLAIM", "b", 2, 2, "ACCEPTED", "RUNNING"),
        (8, "FINALIZE", "a", 2, 2, "LEASE_LOST", "RUNNING"), (9, "FINALIZE", "b", 2, 2, "LEASE_LOST", "RUNNING"), (10, "FINALIZE", "b", 2, 2, "ACCEPTED", "FINALIZED"), (11, "RELEASE", "b", 2, 2, "LEASE_LOST", "FINALIZED"),
    ]


def test_attempts_are_bounded_and_a_given_back_one_is_the_same(spark):
    rows, n = [], 0
    for k in range(4):
        rows += [(1, "c", at(10 * k), n + 1, "QUEUE", None, None, None, None), (1, "c", at(10 * k + 1), n + 2, "CLAIM", "a", None, 9, None), (1, "c", at(10 * k + 2), n + 3, "RELEASE" if k == 0 else "FINALIZE", "a", None, None, "TIMEOUT")]
        n += 3
    got = [(r[1], r[3], r[5]) for r in log_of(spark, rows)]
    assert got[3] == ("QUEUE", 1, "ALREADY_OPEN") and got[4] == ("CLAIM", 1, "ACCEPTED") and got[9][0] == "QUEUE" and max(r[1] for r in got) == 3
    spent = [r for r in log_of(spark, [*rows, (1, "c", at(90), 99, "QUEUE", None, None, None, None)]) if r[0] == 99]
    assert spent[0][5] == "ATTEMPTS_SPENT"


def test_open_leases_end_with_the_log_or_later(spark):
    rows = [(1, "c", at(0), 1, "QUEUE", None, None, None, None), (1, "c", at(1), 2, "CLAIM", "a", None, 10, None), (2, "c", at(11), 3, "WHAT", None, None, None, None), (None, "c", at(1), 4, "QUEUE", None, None, None, None), (3, None, at(1), 5, "QUEUE", None, None, None, None)]
    assert [r[1] for r in log_of(spark, rows)] == ["QUEUE", "CLAIM", "WHAT"]
    assert [r[1] for r in log_of(spark, rows, F.lit(at(12)))] == ["QUEUE", "CLAIM", "SWEEP", "WHAT"]
    assert log_of(spark, []) == []


def made(n, seed):
    rng = random.Random(seed)
    kinds = ["QUEUE", "CLAIM", "CLAIM", "HEARTBEAT", "RELEASE", "FINALIZE"]
    return [(rng.randrange(6), rng.choice("xy"), at(60 * i + rng.randrange(50)), i, rng.choice(kinds), rng.choice("ab"), rng.choice([None, None, 1, 2]), rng.choice([300, 3000]), "OK") for i in range(n)]


def run_stream(spark, folder):
    stream = spark.readStream.schema(leases.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = leases.lease_stream(stream, "1 hour").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)


def test_the_stream_is_the_batch_also_after_a_restart(spark, tmp_path):
    rows, rng = made(240, 1), random.Random(2)
    end = [(99, "z", at(3 * 24 * 3600 + i), 10_000 + i, "QUEUE", None, None, None, None) for i in range(2)]  # moves the watermark past all else

    def put(name, part):
        rng.shuffle(part)  # within the allowed lateness order doesn't matter
        events(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    for k in range(0, 120, 40):
        put(f"{k:04d}", rows[k:k + 40])
    run_stream(spark, tmp_path)
    early = spark.read.parquet(f"{tmp_path}/out").count()
    for k in range(120, 240, 40):
        put(f"{k:04d}", rows[k:k + 40])
    put("8000", end[:1])
    put("9000", end[1:])
    run_stream(spark, tmp_path)  # goes on from the checkpoint
    got = spark.read.parquet(f"{tmp_path}/out")
    want = leases.lease_log(events(spark, rows + end)).filter("source_id <> 99").select(*got.columns)
    assert early > 0 and sorted(map(str, got.filter("source_id <> 99").collect())) == sorted(map(str, want.collect()))


def test_late_events_are_left_out_of_the_stream(spark, tmp_path):
    parts = [[(1, "c", at(0), 1, "QUEUE", None, None, None, None)], [(2, "c", at(9000), 2, "QUEUE", None, None, None, None)], [(2, "c", at(9001), 3, "QUEUE", None, None, None, None)], [(1, "c", at(10), 4, "CLAIM", "a", None, 60, None)], [(2, "c", at(99_000), 5, "QUEUE", None, None, None, None)], [(2, "c", at(99_001), 6, "QUEUE", None, None, None, None)]]
    for i, part in enumerate(parts):
        events(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    run_stream(spark, tmp_path)
    assert 4 not in {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_reactions_to_every_status(spark):
    rows = [
        (1, 1, at(1), 1, "RATE_LIMITED", 429, 30.0), (1, 2, at(2), 2, "RATE_LIMITED", 429, None), (1, 3, at(3), 3, "RATE_LIMITED", 429, 0.0), (1, 4, at(4), 1, "RATE_LIMITED", 429, None), (1, 5, at(5), 1, "OK", 200, None), (1, 6, at(6), 1, "RATE_LIMITED", 429, None),
        (2, 7, at(1), 2, "DNS_TEMPORARY", None, None), (2, 8, at(2), 1, "NAME_NOT_RESOLVED", None, None), (2, 9, at(3), 1, "BLOCKED", 403, None), (3, 10, at(1), 1, "TIMEOUT", None, None), (3, 11, at(2), 2, "HTTP_ERROR", 503, 9999.0), (3, 12, at(3), 1, "HTTP_ERROR", 404, None),
        (3, 13, at(4), 3, "TIMEOUT", None, None), (3, 14, at(5), 1, "INTERNAL_ERROR", None, None), (3, 15, at(6), 1, "ABANDONED", None, None),
    ]
    df = spark.createDataFrame(rows, "source_id long, run_id long, at timestamp, attempt_no int, status string, http_status int, retry_after double")
    r = leases.reactions(df)
    got = {x.run_id: (x.pause_s, x.host_pause_s, x.retry_s, x.strikes, x.judgement) for x in r.collect()}
    assert got == {
        1: (30, 30, 30, 1, None), 2: (900, 900, 900, 2, None), 3: (900, 900, None, 3, None), 4: (900, 900, None, 4, "NEEDS_MANUAL_REVIEW"), 5: (None, None, None, 0, "CLEARED"), 6: (900, 900, 900, 1, None),
        7: (300, None, 300, 0, None), 8: (None, None, None, 0, "NEEDS_MANUAL_REVIEW"), 9: (None, None, None, 0, "BLOCKED"), 10: (None, None, 15, 0, None), 11: (None, None, 3600, 0, None), 12: (None, None, None, 0, None),
        13: (None, None, None, 0, None), 14: (None, None, None, 0, None), 15: (None, None, None, 0, None),
    }
    sources, hosts = leases.standings(r, spark.createDataFrame([(1, "h"), (2, "h"), (3, "g")], "source_id long, host string"))
    utc = lambda t: t and t.replace(tzinfo=dt.timezone.utc)
    assert {(x.source_id, utc(x.cooldown_until), x.eligibility, x.strikes) for x in sources.collect()} == {(1, at(906), "NEEDS_MANUAL_REVIEW", 1), (2, at(301), "NEEDS_MANUAL_REVIEW", 0), (3, None, "FETCHABLE", 0)}
    assert [(x.host, utc(x.paused_until)) for x in hosts.collect()] == [("h", at(906))]


FETCH = "run_id long, source_id long, at timestamp, status string, http_status int, content binary"


def test_recording_again_changes_nothing_and_a_failed_batch_leaves_nothing(spark, tmp_path):
    r = recording.Recorder(spark, str(tmp_path / "t"))
    assert r.table("runs").count() == 0 and r.last() == -1
    first = spark.createDataFrame([(1, 1, at(1), "OK", 200, b"a"), (2, 1, at(2), "UNCHANGED", 304, None), (3, 2, at(3), "OK", 200, b"a"), (4, 2, at(4), "TIMEOUT", None, b"x"), (5, 3, at(5), "OK", 200, None), (5, 3, at(5), "OK", 200, None), (None, 3, at(5), "OK", 200, b"q")], FETCH)
    second = spark.createDataFrame([(6, 1, at(6), "UNCHANGED", 304, None), (7, 1, at(7), "OK", 200, b"b"), (8, 1, at(8), "UNCHANGED", 304, None), (9, 2, at(9), "OK", 200, b"a"), (10, 4, at(9), "UNCHANGED", 304, None)], FETCH)
    assert r.record(first, 0) is True
    state = lambda: [sorted(map(str, r.table(t).collect())) for t in recording.SCHEMAS]
    one = state()
    assert r.record(first, 0) is False and state() == one
    # a batch that stops half way: its files are there, its number isn't in the log
    second.select("run_id", "source_id", "at", "status", "http_status", F.lit(None).cast("string").alias("unchanged_content_hash"), F.lit(0).cast("long").alias("byte_size")).write.parquet(str(tmp_path / "t" / "runs" / "batch=1"))
    assert state() == one
    assert r.record(second, 1) is True
    a, b = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b"))
    assert {x.run_id: x.unchanged_content_hash for x in r.table("runs").collect()} == {1: None, 2: a, 3: None, 4: None, 5: None, 6: a, 7: None, 8: b, 9: None, 10: None}
    assert sorted((x.content_hash, bytes(x.content), x.byte_size, x.first_run, x.batch) for x in r.table("blobs").collect()) == sorted([(a, b"a", 1, 1, 0), (b, b"b", 1, 7, 1)])
    assert sorted(x.run_id for x in r.table("snapshots").collect()) == [1, 3, 7, 9]


def test_recording_as_a_stream_that_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5), at(i), rng.choice(["OK", "UNCHANGED", "TIMEOUT"]), 200, str(rng.randrange(12)).encode()) for i in range(60)]
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k:k + 20], FETCH).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    r = recording.Recorder(spark, f"{tmp_path}/t")
    calls = []

    def once_more(batch, number):
        r.record(batch, number)
        calls.append(number)
        if calls == [0, 1]:
            raise RuntimeError("after the batch was recorded, before the stream knew")

    def start():
        stream = spark.readStream.schema(FETCH).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        return stream.writeStream.foreachBatch(once_more).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="before the stream knew"):
        start().awaitTermination(200)
    start().awaitTermination(200)
    assert calls == [0, 1, 1, 2]
    assert sorted(x.run_id for x in r.table("runs").collect()) == list(range(60))
    brought = {}
    for run, _, _, status, _, content in rows:
        if status == "OK":
            brought.setdefault(content, run)
    assert {bytes(x.content): x.first_run for x in r.table("blobs").collect()} == brought
