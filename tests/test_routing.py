"""Routing of extractors, quotes and locators on literal cases and against SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.operators import documents, routing
from claimloom.plans import routes

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", routes.QUERIES)
def test_queries_are_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    want = con.execute(routes.ORACLE_SQL[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    got = routes.QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert rows and sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


def test_an_extractor_runs_once_a_page(spark):
    rows = [("a", 2, "PROGRAM_PAGE"), ("a", 1, "ENTRY_REQUIREMENTS"), ("b", 1, "UNIVERSITY_HOME"), ("c", 1, None), (None, 1, "TUITION_FEES")]
    c = spark.createDataFrame(rows, "doc string, ref int, r string")
    got = {tuple(x) for x in routing.authorised(c, "doc", "ref", "r").collect()}
    assert got == {("a", "admission", 1, "ENTRY_REQUIREMENTS"), ("a", "language", 1, "ENTRY_REQUIREMENTS"), ("a", "program", 2, "PROGRAM_PAGE"), (None, "tuition", 1, "TUITION_FEES")}
    assert routing.authorised(c.limit(0), "doc", "ref", "r").collect() == []


def test_quotes_stand_where_they_were_cited(spark):
    blocks = ["Apply  by\n1 May.", "Fees: £9,000", "Apply by 1 May.", None]
    cases = [("Apply by 1 May", 2, 2), ("Apply by 1 May", None, 0), ("Apply by 1 May", 1, 0), ("apply by", 0, None), (" \n", 0, None), (None, 0, None), ("Fees", 9, 1), ("Fees", -1, 1)]
    q = spark.createDataFrame([(q, c, blocks) for q, c, _ in cases], "q string, c int, b array<string>")
    assert [r[0] for r in q.select(routing.quote_place(F.col("q"), F.col("c"), F.col("b"))).collect()] == [w for *_, w in cases]


def test_locators_point_into_documents(spark):
    html = "<h1>Fees</h1><ul><li>one<li>two</ul><table><thead><tr><th>Year<th>Fee</thead><tr><td>2026<td>£9</table><a href='/x'>more</a>"
    d = documents.documents(spark.createDataFrame([(1, "http://a.edu/", html)], "page_id long, url string, html string"))
    kinds = "kind string, table_index int, is_header_row boolean, row_index int, column_index int, link_index int, list_index int, list_item_index int, block_index int, char_start int, char_end int"
    cases = {("table_cell", 0, False, 0, 1, *[None] * 6): "£9", ("table_cell", 0, True, 0, 0, *[None] * 6): "Year", ("table_cell", 1, False, 0, 0, *[None] * 6): None, ("link", *[None] * 4, 0, *[None] * 5): "more",
             ("block", *[None] * 7, 0, 1, 3): "ee", ("block", *[None] * 7, 0, None, 3): "Fees", ("block", *[None] * 7, 99, None, None): None, ("block", *[None] * 10): None}
    l = spark.createDataFrame([(c,) for c in cases], f"l struct<{kinds.replace(' ', ':').replace(',:', ', ')}>")
    got = d.crossJoin(l).select("l", routing.located(F.struct("blocks", "tables", "links"), F.col("l"))).collect()
    assert {tuple(a): b for a, b in got} == cases


def test_readers_hints_and_short_texts(spark):
    rows = [("text/html", b"%PDF-1"), ("APPLICATION/pdf;x", b""), (None, None), ("text/html", b"<p>%PDF-")]
    r = spark.createDataFrame(rows, "t string, p binary")
    assert [x[0] for x in r.select(routing.reader_of(F.col("t"), F.col("p"))).collect()] == ["pdf", "pdf", "html", "html"]
    h = spark.createDataFrame([(" Universal ", "x" * 400), ("all", "x" * 399), (None, None)], "h string, t string")
    assert [tuple(x) for x in h.select(routing.hinted_scope(F.col("h")), routing.usable(F.col("t"))).collect()] == [("UNIVERSAL", True), ("SCOPE_MAPPING_REQUIRED", False), ("SCOPE_MAPPING_REQUIRED", False)]
