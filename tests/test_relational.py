"""Every relational query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def normal(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v).removesuffix("+00:00")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())


def test_block_statistics_counts_body_and_chrome(spark):
    from claimloom.operators import documents

    html = "<nav><ul><li>Menu</li></ul></nav><h1>Title</h1><script>x<p>no</p></script><p>One <b>two</b></p>"
    docs = documents.documents(spark.createDataFrame([(1, "u", html), (2, None, None)], "page_id long, url string, html string"))
    got = docs.filter("page_id = 1").head().blocks
    assert [(b.kind, b.level, b.text, b.in_chrome) for b in got] == [("li", None, "Menu", True), ("h1", 1, "Title", False), ("p", None, "One two", False)]
    assert {tuple(r) for r in documents.block_statistics(docs).collect()} == {(1, 3, 1, 12, 1), (2, 0, 0, 0, 0)}


def test_entry_imports_without_llm(tmp_path):
    """In a copy without the training-data package and the pipeline, the entry still imports and names all other queries."""
    import shutil
    import subprocess
    import sys

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "claimloom", tmp_path / "claimloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert set(QUERIES) == set(said.stdout.split())


def test_canonical_urls(spark):
    from claimloom.functions.urls import canonical

    cases = {
        "HTTP://Uni.Example.AC.UK:80": (None, "http://uni.example.ac.uk/"), "https://a.edu:8443/p?q=1#f": (None, "https://a.edu:8443/p?q=1"), "https://localhost-college.ac.uk/": (None, "https://localhost-college.ac.uk/"),
        "ftp://a.edu/": ("SCHEME", None), "http://u:p@a.edu/": ("CREDENTIALS", None), "http://127.0.0.1/": ("IP_LITERAL", None), "http://[::1]/": ("IP_LITERAL", None), "http://127.1/": ("NUMERIC_SUFFIX", None),
        "http://localhost/": ("RESERVED_HOST", None), "http://x.internal/": ("RESERVED_HOST", None), "http://a.edu:22/": ("PORT", None), "http://single/": ("BAD_HOST", None), "http://a.edu/a b": ("FORBIDDEN_CHARACTER", None), "": ("EMPTY", None), None: ("EMPTY", None),
    }
    c = canonical(F.col("url"))
    got = spark.createDataFrame([(u,) for u in cases], "url string").select("url", *[v.alias(k) for k, v in c.items()]).collect()
    assert {r.url: (r.rejection, r.canonical) for r in got} == cases


def test_governing_scope_of_ties_and_open_groups(spark):
    from claimloom.operators.review import governing

    rows = [
        (1, 10, ["J:CN"], False, "S"), (1, 11, [], False, "UNIVERSAL_EXPLICIT"), (2, 20, ["J:CN"], False, "S"), (2, 21, ["Q:A"], False, "S"),
        (3, 30, ["J:CN"], False, "S"), (3, 31, ["J:CN"], True, "S"), (4, 40, ["J:CN"], True, "S"), (4, 41, ["J:CN"], True, "S"), (5, 50, ["J:CN"], True, "S"), (5, 51, [], True, "UNSCOPED"),
    ]
    g = governing(spark.createDataFrame(rows, "k int, id int, c array<string>, human boolean, state string"), "k", "id", "c", "human", "state")
    assert {r.k: r.governing_id for r in g.collect()} == {1: 10, 2: None, 3: 31, 4: None, 5: None}


def test_governing_scope_whole_covers_every_order(spark, duck):
    got = QUERIES["governing_scope_whole"](spark, SF).agg(F.sum("n_scopes")).head()[0]
    assert got == duck.execute("select count(*) from orders").fetchone()[0]
