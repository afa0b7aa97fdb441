"""Records of fetches and intake of sources on literal cases."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from claimloom.functions import records
from claimloom.operators import intake


def test_credentials_are_masked(spark):
    cases = {
        "http://a/?Token=x&q=a+b%2Fc~*#top": "http://a/?Token=%5Bredacted%5D&q=a+b%2Fc~%2A#top", "http://a/?q=%zz&key=": "http://a/?q=%25zz&key=%5Bredacted%5D", "http://a/?monkey=1&tree=2,0": "http://a/?monkey=1&tree=2,0",
        "http://a/": "http://a/", "http://a/#?key=1": "http://a/#?key=1", "http://a/?&sid": "http://a/?sid=%5Bredacted%5D", "": "", None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", records.redacted(F.col("u"))).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_headers_destinations_and_bodies(spark):
    h = spark.createDataFrame([({"ETag": "e" * 600, "Set-Cookie": "s"},), ({"X": "y"},), (None,)], "h map<string,string>")
    assert [r[0] for r in h.select(records.kept_headers(F.col("h"))).collect()] == [{"ETag": "e" * 512}, None, None]
    cases = {("英国", "United Kingdom"): ("GB", None), ("英国", "Australia"): (None, "DISAGREE"), (" 香港 ", None): ("HK", None), ("法国", ""): (None, "UNRECOGNISED"), (None, " "): (None, "NO_LABEL"), ("法国", "Ireland"): ("IE", None)}
    d = records.destination(F.col("r"), F.col("t"))
    rows = spark.createDataFrame(list(cases), "r string, t string").select("r", "t", d["code"], d["problem"]).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in rows} == cases
    b = spark.createDataFrame([("link", "main"), ("block", "article"), ("block", "form"), ("block", None)], "k string, c string")
    assert [r[0] for r in b.select(records.body_confirmation(F.col("k"), F.col("c"))).collect()] == ["NOT_RECORDED", "CONFIRMED", "PERIPHERAL", "UNCONFIRMED"]


def test_fingerprints_are_those_of_sorted_ascii_json(spark):
    rows = spark.createDataFrame([("x", 'É "q" \\ 学费 😀 \x7f', 3), ("y", None, None)], "e string, h string, i int")
    f = records.claim_fingerprint(F.col("e"), F.lit("K"), {"kind": F.lit("block"), "heading": F.col("h"), "block_index": F.col("i")}, F.lit("r"), F.lit("1"))
    for e, h, i, got in rows.select("e", "h", "i", f).collect():
        place = {k: v for k, v in {"kind": "block", "heading": h, "block_index": i}.items() if v is not None}
        said = json.dumps({"extraction_id": e, "field_kind": "K", "locator": place, "extractor": "r", "version": "1"}, sort_keys=True, separators=(",", ":"))
        assert got == hashlib.sha256(said.encode()).hexdigest()


def test_registration_takes_one_source_an_address(spark):
    claims = spark.createDataFrame([("h", "http://a/x.PDF", 2, "TUITION_FEES", None), ("h", "http://a/x.PDF", 1, "NEWS", None), ("g", "http://a:9/", 3, None, "PORT"), (None, None, 4, None, "EMPTY")], "url_hash string, url string, source_ref int, category string, rejection string")
    got = sorted(map(tuple, intake.registered(claims, claims.filter("url_hash = 'g'")).collect()))
    assert got == [("g", 3, "unclassified", "STATIC", "NEEDS_MANUAL_REVIEW", 1, False), ("h", 1, "unclassified", "DOCUMENT", "FETCHABLE", 2, True)]
    assert intake.registered(claims.limit(0), claims.limit(0)).collect() == []


def test_recovery_actions(spark):
    s = spark.createDataFrame([(1, True, "BLOCKED", "BLOCKED", "2024-01-01"), (2, False, "FETCHABLE", "OK", "2024-01-01"), (3, True, "FETCHABLE", "OK", None)], "source_id int, is_active boolean, fetch_eligibility string, access_state string, cooldown_until string")
    a = spark.createDataFrame([(1, 1, "DISABLE"), (1, 2, "REENABLE"), (2, 1, "REENABLE"), (2, 2, "CLEAR_COOLDOWN"), (3, 1, "REENABLE"), (3, 2, "NEEDS_REVIEW"), (9, 1, "DISABLE")], "source_id int, action_id int, action string")
    got = sorted(map(tuple, intake.recovered(s, a).collect()))
    assert got == [(1, True, "FETCHABLE", "OK", None, 0), (2, False, "FETCHABLE", "OK", None, 1), (3, True, "NEEDS_MANUAL_REVIEW", "OK", None, 0)]


def test_rounds_come_from_the_wording_before_the_heading(spark):
    rows = [("January 4 for Regular Decision", "Early Action"), ("May 1", "Round 2 (2026/27)"), ("Single-choice early action", None), ("none", None), (None, None)]
    c = intake.deadline_context(F.col("t"), F.col("h"))
    got = spark.createDataFrame(rows, "t string, h string").select(*[v.alias(n) for n, v in c.items()]).collect()
    assert [tuple(r)[:4] for r in got] == [("regular decision", "text", None, None), ("round 2", "heading", 2, "2026/27"), ("single choice early action", "text", None, None), (None, None, None, None), (None, None, None, None)]


def test_vocabulary_and_matrix_of_empty_arrays(spark):
    c = spark.createDataFrame([(1, "k", [], "a", []), (1, "k", ["B"], "b", [("m", "x"), ("m", "x")]), (2, None, None, "c", None)], "i int, k string, b array<string>, e string, s array<struct<marker:string,kind:string>>")
    got = {tuple(r) for r in intake.blocker_matrix(c.fillna("?").withColumn("b", F.coalesce("b", F.array().cast("array<string>"))), "i", "k", "b").collect()}
    assert {(1, "CURRENT", "all", 2), (1, "READY", "all", 1), (1, "BLOCKER", "B", 1), (2, "READY_OF_KIND", "?", 1)} <= got
    assert [tuple(r) for r in intake.scope_vocabulary(c, "s", "e", "i").collect()] == [("m", "x", 2, "b")]
