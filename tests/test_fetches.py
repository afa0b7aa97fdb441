"""Retry-After, challenges, and how located texts relate to claims, against plain Python."""

from __future__ import annotations

import datetime as dt
from email.utils import format_datetime, parsedate_to_datetime

from pyspark.sql import functions as F

from claimloom.functions import fetches
from claimloom.operators import context

NOW = dt.datetime(2024, 2, 28, 12, 0, tzinfo=dt.timezone.utc)


def test_when_to_come_back(spark):
    dates = [format_datetime(NOW + dt.timedelta(seconds=s), usegmt=True) for s in (0, 1, 86_400, 99_999, -5, 400 * 86_400)] + ["28 Feb 2024 13:00:00 GMT", "Wednesday, 28-Feb-24 12:00:30 GMT", "Wed, 28 Feb 2024 14:00:00 +0130", "Thu, 29 Feb 2024 00:00 GMT"]
    values = [("0", 0.0), ("120", 120.0), (" 7 ", 7.0), ("-3", 0.0), ("+4", 4.0), ("1.5", None), ("soon", None), ("", None), (None, None), ("Fri, 30 Feb 2024 00:00:00 GMT", None), ("Wed, 28 Feb 2024 25:00:00 GMT", None), ("Wed, 28 Xyz 2024 01:00:00 GMT", None)]
    values += [(d, max(0.0, (parsedate_to_datetime(d).replace(tzinfo=parsedate_to_datetime(d).tzinfo or dt.timezone.utc) - NOW).total_seconds())) for d in dates]
    df = spark.createDataFrame(values, "v string, want double").withColumn("got", fetches.retry_after(F.col("v"), F.lit(NOW)))
    assert [(r.v, r.got) for r in df.collect()] == [(v, w) for v, w in values]


def test_challenges_are_small_html(spark):
    mark = b"x Just a moment... x"
    rows = [(mark, "text/html", True), (mark, None, True), (mark, "TEXT/HTML;charset=utf-8", True), (mark, "application/pdf", False), (mark + b" " * 9000, "text/html", False), (b"just a moment", "text/html", False), (None, "text/html", False), (b"", None, False), ("é/cdn-cgi/challenge-platform".encode(), "application/xhtml+xml", True)]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, c, w) for b, c, w in rows], "b binary, c string, want boolean")
    assert [r.m is not None for r in df.select(fetches.challenge(F.col("b"), F.col("c")).alias("m")).collect()] == [w for *_, w in rows]


def slow_relation(resolved, raw, evidence):
    if resolved is None:
        return "UNRESOLVED"
    raw, evidence = (raw or "").strip(), (evidence or "").strip()
    if resolved == raw:
        return "EXACT_RAW"
    if raw and raw in resolved:
        return "CONTAINS_RAW"
    if raw.split() and all(t in resolved for t in raw.split()):
        return "ALL_RAW_TOKENS_PRESENT"
    own = resolved.strip()
    if own == evidence:
        return "EQUALS_EVIDENCE"
    return "WITHIN_EVIDENCE" if evidence and (own in evidence or evidence in own) else "MISMATCH"


def test_relations_of_all_wordings(spark):
    texts = [None, "", " ", "a", "a b", "b a", " a b c ", "c", "a b", "ab", "\n"]
    rows = [(x, y, z) for x in texts for y in texts for z in texts]
    got = spark.createDataFrame(rows, "r string, w string, e string").withColumn("k", fetches.evidence_relation(F.col("r"), F.col("w"), F.col("e"))).collect()
    assert [(x.r, x.w, x.e, x.k) for x in got] == [(*r, slow_relation(*r)) for r in rows]


def test_groups_keep_places_and_tests_apart(spark):
    kind = "claim_id long, extraction_id long, institution string, url string, kind string, locator_kind string, block_index long, list_item_index long, table_index long, row_index long, link_index long, test string"
    rows = [
        (1, 1, "i", "u", "PROGRAM_NAME", "block", 3, None, None, None, None, None), (2, 1, "j", "v", "DEGREE_LEVEL", "block", 3, None, None, None, None, None), (3, 1, "i", "u", "PROGRAM_NAME", "link", None, None, None, None, 3, None), (4, 2, "i", "u", "PROGRAM_NAME", "block", 3, None, None, None, None, None),
        (5, 1, "i", "u", "LANGUAGE_OVERALL_SCORE", "block", 4, 0, None, None, None, "IELTS"), (6, 1, "i", "u", "LANGUAGE_COMPONENT_SCORE", "block", 4, 0, None, None, None, "IELTS"), (7, 1, "i", "u", "LANGUAGE_OVERALL_SCORE", "block", 4, 0, None, None, None, "TOEFL"), (8, 1, "i", "u", "TUITION", "block", 3, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    p = {(r.extraction_id, r.anchor): (r.members, r.kinds, r.institution) for r in context.context_groups(df, context.PROGRAM_KINDS, context.program_anchor()).collect()}
    assert p == {(1, "block/block_index=3"): (2, ["DEGREE_LEVEL", "PROGRAM_NAME"], "i"), (1, "link/link_index=3"): (1, ["PROGRAM_NAME"], "i"), (2, "block/block_index=3"): (1, ["PROGRAM_NAME"], "i")}
    g = context.context_groups(df, context.LANGUAGE_KINDS, context.language_anchor())
    assert {r.anchor: r.members for r in g.collect()} == {"block=4/item=0/test=IELTS": 2, "block=4/item=0/test=TOEFL": 1}
    assert {(r.members, r.kinds, r.groups) for r in context.group_shapes(g).collect()} == {(2, "LANGUAGE_COMPONENT_SCORE+LANGUAGE_OVERALL_SCORE", 1), (1, "LANGUAGE_OVERALL_SCORE", 1)}
