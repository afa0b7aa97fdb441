"""Bytes to text, each way of saying what they are."""

from __future__ import annotations

from claimloom.operators import charsets

TEXT = "<p>Überblick – “fees” 学费</p>"
LATIN = "<p>Überblick</p>"
META = '<meta charset="{}">'
CASES = {
    "utf8 undeclared": (TEXT.encode(), None, (TEXT, "utf-8", True, 0, [])),
    "utf8 by http": (TEXT.encode(), "text/html; charset=UTF-8", (TEXT, "utf-8", False, 0, [])),
    "latin by http": (LATIN.encode("latin-1"), 'text/html; charset="ISO-8859-1"; x=y', (LATIN, "iso8859-1", False, 0, [])),
    "gbk by meta": ((META.format("gbk") + TEXT.replace("Ü", "U").replace("–", "-").replace("“", "").replace("”", "")).encode("gbk"), "text/html", (META.format("gbk") + "<p>Uberblick - fees 学费</p>", "gbk", False, 0, [])),
    "wrong http, right meta": ((META.format("windows-1252") + LATIN).encode("cp1252"), "text/html;charset=utf-8", (META.format("windows-1252") + LATIN, "cp1252", False, 0, ["http:utf-8 (UnicodeDecodeError)"])),
    "unknown name": (TEXT.encode(), "text/html; charset=none", (TEXT, "utf-8", True, 0, ["http:none (unknown codec)"])),
    "nothing fits": (b"<p>\xdc\x81\xff</p>", "text/html; charset=utf-8", ("<p>Ü�ÿ</p>", "cp1252", True, 1, ["http:utf-8 (UnicodeDecodeError)", "fallback:utf-8 (UnicodeDecodeError)"])),
    "utf16 by mark": (b"\xff\xfe" + TEXT.encode("utf-16-le"), None, ("﻿" + TEXT, "utf-16-le", False, 0, [])),
    "utf8 mark": (b"\xef\xbb\xbf" + TEXT.encode(), None, (TEXT, "utf-8-sig", False, 0, [])),
    "late meta": (b" " * 5000 + META.format("gbk").encode() + b"x", None, (" " * 5000 + META.format("gbk") + "x", "utf-8", True, 0, [])),
    "empty": (b"", None, ("", "utf-8", True, 0, [])), "null": (None, "text/html; charset=gbk", (None,) * 5),
}


def test_every_way_of_declaring(spark):
    df = spark.createDataFrame([(k, bytearray(p) if p is not None else None, c, "clash") for k, (p, c, _) in CASES.items()], "name string, payload binary, content_type string, text string")
    got = {r.name: (r.text, r.used, r.fallback_used, r.replacement_characters, r.attempts) for r in charsets.decoded(df).collect()}
    for name, (_, _, expected) in CASES.items():
        assert got[name] == expected, name
    lossy = {r.name for r in charsets.decoded(df).filter("lossy").collect()}
    assert lossy == {"nothing fits"} and charsets.decoded(df.limit(0)).count() == 0


def test_only_bytes_that_need_it_go_to_python(spark, monkeypatch, tmp_path):
    """Plain pages are null where Python gets them: the plan tests them before, and their result is the cast."""
    rows = [(bytearray(TEXT.encode()), None)] * 3 + [(bytearray(LATIN.encode("latin-1")), "text/html; charset=latin1")]
    df = spark.createDataFrame(rows, "payload binary, content_type string")
    assert sorted(r.used for r in charsets.decoded(df).collect()) == ["iso8859-1", "utf-8", "utf-8", "utf-8"]
    plan = charsets.decoded(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "CASE WHEN NOT" in plan
