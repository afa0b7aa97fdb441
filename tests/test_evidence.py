"""Operators over sources, registers, claims and values on literal cases; streams as streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import random

from pyspark.sql import functions as F

from claimloom.functions import values
from claimloom.operators import documents, fleet, grouping, registers
from claimloom.streaming import runs as windows
from claimloom.streaming import state


def test_addresses_of_every_kind(spark):
    kinds = {
        "8.8.8.8": "GLOBAL", "127.0.0.1": "LOOPBACK", "::1": "LOOPBACK", "::ffff:127.0.0.1": "LOOPBACK", "::FFFF:7f00:1": "LOOPBACK", "10.1.2.3": "PRIVATE", "100.64.0.1": "NOT_GLOBAL", "169.254.169.254": "METADATA", "::ffff:169.254.169.254": "METADATA",
        "169.254.1.1": "LINK_LOCAL", "0.0.0.0": "UNSPECIFIED", "::": "UNSPECIFIED", "2002:7f00:1::": "LOOPBACK", "224.0.0.1": "MULTICAST", "2001:4860:4860::8888": "GLOBAL", "fd00:ec2::254": "METADATA", "fd00::1": "PRIVATE", "fe80::1%eth0": "LINK_LOCAL",
        "ff02::1": "MULTICAST", "2001:0:4136:e378:8000:63bf:80ff:fffe": "LOOPBACK", "abc": "INVALID", "": "INVALID", "1.2.3": "INVALID", "1.2.3.256": "INVALID", "01.2.3.4": "INVALID", "1::2::3": "INVALID", "1:2:3:4:5:6:7": "INVALID",
        "1:2:3:4:5:6:7:8:9": "INVALID", "1:2:3:4:5:6:7::8": "INVALID", "g::": "INVALID", "1.2.3.4\n": "INVALID", ":::": "INVALID", None: None,
    }
    df = spark.createDataFrame([(a,) for a in kinds], "a string")
    assert {r[0]: r[1] for r in df.select("a", values.address_class(F.col("a"))).collect()} == kinds


def test_addresses_agree_with_the_standard_library_where_it_can_tell(spark):
    rng = random.Random(1)
    some = [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(400)] + [ipaddress.ip_address(rng.getrandbits(rng.choice([16, 64, 125, 128]))) for _ in range(400)]
    texts = {x: a for a in some for x in (str(a), a.exploded)}
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in texts], "a string").select("a", values.address_class(F.col("a"))).collect()}
    for text, a in texts.items():
        if a.version == 6 and (a.ipv4_mapped or a.sixtofour or a.teredo):
            continue
        if got[text] == "GLOBAL":
            assert a.is_global, text
        elif got[text] not in ("MULTICAST", "RESERVED", "METADATA"):
            assert not a.is_global, text


def test_names_without_their_writing(spark):
    names = {"  Ａ University\u200b of “X”. ": 'a university of "x"', "STRASSE": "strasse", "Straße": "strasse", "a – b;": "a - b", " .,": None, "A\u00a0 B": "a b", "plain  Name.": "plain name", None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", values.name_key(F.col("n"))).collect()} == names


def test_names_differ_in_writing_only(spark):
    rows = spark.createDataFrame([("The “X”", 'the "x".'), ("a", "b"), (None, "a"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(values.same_name(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_partial_dates(spark):
    rows = [(2027, 2, 30), (2027, 2, 28), (2028, 12, None), (2027, None, None), (None, 1, 1), (2027, 12, 31)]
    df = spark.createDataFrame(rows, "y int, m int, d int")
    r = values.date_range(F.col("y"), F.col("m"), F.col("d"))
    d = dt.date
    assert [tuple(x) for x in df.select(r["lo"], r["hi"]).collect()] == [(None, None), (d(2027, 2, 28), d(2027, 3, 1)), (d(2028, 12, 1), d(2029, 1, 1)), (d(2027, 1, 1), d(2028, 1, 1)), (None, None), (d(2027, 12, 31), d(2028, 1, 1))]


def test_list_fingerprints_are_those_of_json(spark):
    import json

    rows = [("a", 'b "q" \\ ü'), ("", "x, y")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(values.list_fingerprint([F.col("a"), F.col("b")])).collect()]
    assert got == [hashlib.sha256(json.dumps(list(r), ensure_ascii=False).encode()).hexdigest() for r in rows]


def test_chain_faults(spark):
    log, before = [], None
    for seq in range(1, 9):
        row = hashlib.sha256(((before or "") + f"entry{seq}").encode()).hexdigest()
        log.append([seq, f"entry{seq}", before, row])
        before = row
    check = lambda rows: {(r.seq, r.reason) for r in registers.chain_faults(spark.createDataFrame(rows, "seq long, entry string, prev_hash string, row_hash string"), F.col("entry")).collect()}
    assert check(log) == set()
    changed = [list(r) for r in log]
    changed[3][1] = "forged"
    changed[6][2] = "0" * 64
    assert check(changed) == {(4, "ROW_HASH"), (7, "PREV_HASH")}
    assert check([r for r in log if r[0] != 5]) == {(6, "GAP")} and check([]) == set()


def runs(spark, rows):
    return spark.createDataFrame([(s, i, dt.datetime(2024, 1, 1, h) if h is not None else None, status) for s, i, h, status in rows], "source_id long, run_id long, started_at timestamp, status string")


def test_ties_of_time_go_to_the_later_id(spark):
    r = runs(spark, [(1, 1, 5, "OK"), (1, 2, 5, "TIMEOUT"), (1, 3, None, "BLOCKED"), (2, 4, 1, "RATE_LIMITED")])
    assert {x.source_id: x.status for x in fleet.newest(r, "status").collect()} == {1: "TIMEOUT", 2: "RATE_LIMITED"}
    assert {(x.source_id, x.strikes) for x in fleet.strikes(r).collect()} == {(1, 0), (2, 1)}


def test_best_domain_prefers_status_then_length(spark):
    domains = [("a.edu", "VERIFIED_OFFICIAL", True), ("x.a.edu", "VERIFIED_OFFICIAL", True), ("y.x.a.edu", "CANDIDATE", False), ("b.edu", "LEGACY", False)]
    hosts = [(1, "y.x.a.edu"), (2, "z.a.edu"), (3, "b.edu"), (4, "c.b.edu"), (5, "xa.edu"), (6, None)]
    got = registers.best_domain(spark.createDataFrame(hosts, "id long, host string"), spark.createDataFrame(domains, "host string, status string, covers_subdomains boolean"))
    assert {r.id: r.domain_host for r in got.collect()} == {1: "x.a.edu", 2: "a.edu", 3: "b.edu", 4: None, 5: None, 6: None}


def test_redirect_authority_verdicts(spark):
    domains = spark.createDataFrame([("a", "VERIFIED_OFFICIAL", True, 1), ("b", "VERIFIED_OFFICIAL", True, 2), ("c", "CANDIDATE", True, 1), ("d", "AUTHORIZED_EXTERNAL", False, 1)], "host string, status string, is_active boolean, institution long")
    moves = spark.createDataFrame([(1, "a", None, True), (2, "a", "b", True), (3, "a", "c", True), (4, "d", "a", True), (5, "zz", "a", False), (6, "a", "a", True)], "id long, requested string, effective string, has_evidence boolean")
    assert {r.id: r.verdict for r in registers.redirect_authority(moves, domains).collect()} == {1: "OK", 2: "INSTITUTION_MISMATCH", 3: "EFFECTIVE_UNTRUSTED", 4: "REQUESTED_UNTRUSTED", 5: "NO_EVIDENCE", 6: "OK"}


def test_all_verdicts(spark):
    rows = [(["f=1", "scope=A"], "v1", "s1"), (["f=1", "scope=A"], "v2", "s2"), (["f=2", "scope=UNRESOLVED"], "v1", "s1"), (["f=2", "scope=UNRESOLVED"], "v2", "s1"), (["f=3"], "v", "s1"), (["f=4"], "v", "s1"), (["f=4"], "v", "s2"), (["f=5"], "v", None), (["f=5"], "v", None), (None, "v", "s1")]
    claims = spark.createDataFrame([("k", *r, True) for r in rows] + [("never", None, "v", "s", False)], "kind string, key array<string>, value_key string, source string, comparable boolean")
    got = sorted((r.verdict, r.n_claims) for r in grouping.verdicts(claims, "source").collect())
    assert got == [("AGREES", 2), ("CONFLICTS", 2), ("INSUFFICIENT_CONTEXT", 1), ("INSUFFICIENT_CONTEXT", 2), ("NOT_COMPARABLE", 1), ("POSSIBLE_DUPLICATE", 2), ("SINGLE", 1)]


def test_blocks_end_implicitly_and_pages_without_blocks_stay(spark):
    pages = spark.createDataFrame([(1, "u", "<ul><li>a<li>b</ul>bare<p>one<p>two<div>three</div>"), (2, "u", None), (3, "u", "<table><tr><td>x<td>y<tr><th>z</table>end")], "page_id long, url string, html string")
    docs = documents.documents(pages)
    got = {r.page_id: [(b.kind, b.text) for b in r.blocks] for r in docs.collect()}
    assert got == {1: [("li", "a"), ("li", "b"), ("p", "bare"), ("p", "one"), ("p", "two"), ("p", "three")], 2: [], 3: [("td", "x"), ("td", "y"), ("th", "z"), ("p", "end")]}
    assert {r.page_id: r.blocks for r in documents.block_statistics(docs).collect()}[2] == 0


def test_a_source_with_several_physical_claims_is_one_target(spark):
    sources = spark.createDataFrame([(1,), (2,), (3,)], "source_id long")
    claims = spark.createDataFrame([(1, "S3", "FEES", None), (1, "S2", "DATES", None), (1, "S1", "FEES", "S2"), (2, "S9", "FEES", "S8")], "source_id long, source_ref string, category string, duplicate_of string")
    got = registers.acquisition_targets(sources, claims).collect()
    assert [(r.source_id, r.physical_ref, r.first_category, r.claim_count, r.categories, r.source_refs) for r in got] == [(1, "S2", "DATES", 3, ["DATES", "FEES"], ["S1", "S2", "S3"])]


def test_windowed_counts_as_a_stream_drop_late_rows(spark, tmp_path):
    rows = [(1, 1, 1, "OK"), (1, 2, 1, "OK"), (1, 3, 9, "OK"), (1, 6, 10, "OK"), (1, 4, 1, "OK"), (1, 5, 20, "OK")]
    for i, part in enumerate([rows[:2], *[[r] for r in rows[2:]]]):  # Spark drops what is late by the watermark of a batch ago
        runs(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(runs(spark, []).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = windows.outcomes_by_window(stream.withColumnRenamed("status", "outcome")).writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.window_start.hour, r.runs) for r in spark.table("windowed").collect()}
    assert (1, 2) in got and (1, 3) not in got


def test_strikes_as_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(s, 10 * s + i, i, status) for s, statuses in {1: "LLOLL", 2: "LLLLLL", 3: "LT"}.items() for i, status in enumerate({"L": "RATE_LIMITED", "O": "OK", "T": "TIMEOUT"}[c] for c in statuses)]
    for hour in range(6):
        runs(spark, [r for r in rows if r[2] == hour]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{hour}"))
    stream = spark.readStream.schema(runs(spark, []).schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = state.strikes(stream).writeStream.format("memory").queryName("struck").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    last = {r.source_id: r.strikes for r in spark.table("struck").collect()}
    assert last == {1: 2, 2: 4, 3: 1} == {r.source_id: r.strikes for r in fleet.strikes(runs(spark, rows)).collect()}
