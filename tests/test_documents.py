"""Nested documents of literal pages."""

from __future__ import annotations

import pytest

from claimloom.operators import documents as d

PAGE = """<!doctype html><html lang="en"><head><title> A  <b>x</b> page</title><meta name="Description" content="about"><link rel="canonical" href="https://a.edu/x"><style>p{}</style>
<script type="application/ld+json">{"@graph": [{"@type": "Course"}, {"@type": ["A", "B"]}]}</script><script type="application/ld+json">{bad</script><script id="__NEXT_DATA__">{"k": 1}</script><script>var t = "</p>";</script></head>
<body><nav><ul><li><a href="/m">Menu</a><li><a href="/m">Menu</a></ul></nav><main><h1>Title</h1>bare <b>text</b><p>one<p>two <a href="f.PDF?x">file</a><script>no</script>end
<h2>Fees</h2><ol><li>a<ul><li>inner</ul><li>b</ol><h3>Deep</h3><p>deep</p><h2>Next</h2><table><caption>Cap</caption><thead><tr><th>Level<th colspan=2>Fee</thead><tr><th>BSc<td>9,000<td>1<tr><td rowspan=9999>MSc<td>10,000</table><table><tr><th>k<th>v<tr><td>q<td>r</table>
<dl><dt>t<dd>v</dl></main><footer>foot</footer></body></html>"""


@pytest.fixture(scope="module")
def docs(spark):
    return d.documents(spark.createDataFrame([(1, "https://a.edu/dir/p", PAGE), (2, None, None), (3, "http://[bad", '<a href="http://[x">q</a>'), (1, "u", "<p>x")], "page_id long, url string, html string"))


def test_blocks_in_order(docs):
    doc = docs.filter("title is not null").head()
    assert (doc.title, doc.language, doc.canonical_url, doc.meta, doc.json_ld_types, doc.embedded_json, doc.scripts, doc.warnings) == ("A x page", "en", "https://a.edu/x", {"description": "about"}, ["Course", "A", "B"], 1, 5, ["JSON_MALFORMED: application/ld+json"])
    got = [(b.kind, b.text, b.container, b.in_chrome) for b in doc.blocks]
    assert got[:2] == [("li", "Menu", "nav", True)] * 2
    assert [(k, t) for k, t, _, c in got if not c][:10] == [("h1", "Title"), ("p", "bare text"), ("p", "one"), ("p", "two file"), ("p", "end"), ("h2", "Fees"), ("li", "a"), ("li", "inner"), ("li", "b"), ("h3", "Deep")]
    assert got[-1] == ("p", "foot", "footer", True)
    lists = {b.text: (b.list, b.ordered) for b in doc.blocks if b.kind == "li"}
    assert lists["a"] == lists["b"] != lists["inner"] and lists["a"][1] and not lists["inner"][1]


def test_tables_links_and_counts(docs):
    one = docs.filter("title is not null")
    cells = {(r.table_index, r.row_index, r.column_index): (r.column_header, r.row_label, r.text) for r in d.cells(one).collect()}
    assert cells[0, 0, 1] == ("Fee", "BSc", "9,000") and cells[0, 0, 2] == ("Fee", "BSc", "1") and cells[0, 1, 0] == ("Level", None, "MSc") and cells[1, 0, 1] == ("v", "q", "r")
    table = one.head().tables[0]
    assert table.caption == "Cap" and table.rows[1][0].rowspan == 1000
    links = [(r.text, r.resolved, r.is_pdf, r.in_chrome) for r in d.links(one).collect()]
    assert links == [("Menu", "https://a.edu/m", False, True), ("Menu", "https://a.edu/m", False, True), ("file", "https://a.edu/dir/f.PDF?x", True, False)]
    profile = {r.block_index: (r.links, r.text_fraction, r.is_link_only) for r in d.link_profiles(one).collect()}
    assert profile[0] == (1, 1.0, True) and (1, 0.5, False) in profile.values()
    counts = {(r.page_id, r.status): r for r in d.statistics(docs).collect()}
    assert counts[1, "PARTIAL"].tables == 2 and counts[1, "PARTIAL"].pdf_links == 1 and counts[2, "OK"].blocks == 0 and counts[3, "FAILED"].links == 0 and len(counts) == 4


def test_heading_paths(docs):
    paths = {r.text: r.heading_path for r in d.sections(docs.filter("title is not null")).collect()}
    assert paths["one"] == ["Title"] and paths["inner"] == ["Title", "Fees"] and paths["deep"] == ["Title", "Fees", "Deep"] and paths["9,000"] == ["Title", "Next"]


def slow_grid(rows):
    """Every place tried in turn: a cell goes to the first free place of its row and takes what its spans cover and is free."""
    taken = {}
    for i, row in enumerate(rows):
        for cell in row:
            j = 0
            while (i, j) in taken:
                j += 1
            free = [b for b in range(j, j + cell["colspan"]) if (i, b) not in taken]
            for a in range(i, min(len(rows), i + cell["rowspan"])):
                for b in free:
                    taken.setdefault((a, b), (cell["text"], a == i and b == j))
    return [[taken.get((i, j), ("", False)) for j in range(max((b for a, b in taken if a == i), default=-1) + 1)] for i in range(len(rows))]


def test_grids_of_random_spans_are_those_of_a_slow_layout():
    import random

    rng = random.Random(3)
    for _ in range(300):
        rows, n = [], 0
        for _ in range(rng.randint(0, 5)):
            row = []
            for _ in range(rng.randint(0, 4)):
                n += 1
                row.append({"text": str(n), "header": False, "block": n, "rowspan": rng.choice([1, 1, 2, 3, 1000]), "colspan": rng.choice([1, 1, 2, 3])})
            rows.append(row)
        got = [[(c["text"], c["origin"]) for c in r] for r in d.laid_out(rows)]
        want = slow_grid(rows)
        assert [[c for c in r] for r in got] == want, rows


def test_spans_that_would_cover_too_much_are_not_laid_out():
    rows = [[{"text": "x", "header": False, "block": 0, "rowspan": 1000, "colspan": 1000}] for _ in range(1000)]
    assert [len(r) for r in d.laid_out(rows)] == [1] * 1000


def test_headers_of_several_rows_and_labels_over_rows(spark):
    html = "<table><thead><tr><th rowspan=2>Level<th colspan=2>Fee<tr><th>Home<th>Abroad</thead><tr><td rowspan=0>BSc<td>1<td>2<tr><td colspan=2>3</table>"
    docs = d.documents(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    got = {(r.row_index, r.column_index): (r.text, r.origin, r.column_header, r.row_label) for r in d.cells(docs).collect()}
    assert got[0, 1] == ("1", True, "Fee Home", "BSc") and got[1, 0] == ("BSc", False, "Level", None) and got[1, 1] == ("3", True, "Fee Home", "BSc") and got[1, 2] == ("3", False, "Fee Abroad", "BSc")
    assert [(r.text, r.column_header) for r in d.statements(docs).orderBy("place").collect()] == [("BSc", "Level"), ("1", "Fee Home"), ("2", "Fee Abroad"), ("3", "Fee Home")]


def test_profiled_links_stay_with_their_document_without_a_join(spark):
    html = '<p><a href="/a">all</a><p>see <a href="/b">é1</a> and <a href="/c">it</a><p>none</p><a href="/d"></a>'
    docs = d.documents(spark.createDataFrame([(None, "https://a.edu/", html), (1, "https://a.edu/", html), (1, "https://a.edu/", "<p>x <a href=y>y</a>")], "page_id long, url string, html string"))
    links = d.profiled_links(docs)
    got = sorted(((r.page_id or 0), r.href, r.text_fraction, r.is_link_only, r.is_link_dominated) for r in links.collect())
    one = [("/a", 1.0, True, True), ("/b", 0.308, False, False), ("/c", 0.308, False, False)]
    assert got == sorted([(n, *x) for n in (0, 1) for x in one] + [(1, "y", 0.333, False, False)])
    assert sorted((r.block_index, r.links, r.text_fraction) for r in d.link_profiles(docs).filter("page_id is null").collect()) == [(0, 1, 1.0), (1, 2, 0.308)]
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (links, d.link_profiles(docs))]
    assert all("Join" not in p and "Exchange" not in p and p.count("MapInArrow") == 1 for p in plans)


def test_statements_read_each_page_once(spark):
    docs = d.documents(spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string"))
    assert d.statements(docs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.place, r.kind, r.text, r.heading, r.column_header, r.row_label) for r in d.statements(docs).collect()}
    assert {(x[1], x[2], x[3], x[4], x[5]) for x in got} >= {("p", "bare text", "Title", None, None), ("li", "inner", "Fees", None, None), ("td", "9,000", "Next", "Fee", "BSc"), ("td", "BSc", "Next", "Level", None), ("dt", "t", "Next", None, None)}
    blocks = docs.head().blocks
    assert all(blocks[place].text == text for place, _, text, *_ in got)


@pytest.mark.parametrize("name", ["outlined_blocks", "outlined_paths", "outlined_links", "outlined_texts", "score_tables", "page_fees", "fee_tables", "table_places", "fee_sentences", "score_sentences", "admission_requirements"])
def test_rows_of_a_small_file_are_dealt_to_many_tasks(spark, tmp_path, name):
    from claimloom.plans.pages import QUERIES

    rows = spark.range(20_001).selectExpr("id as p_partkey", "concat('n', id) as p_name", "cast(id % 50 as int) as p_size")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 5


def test_runs_of_plain_tags_are_read_as_the_parser_reads_them():
    import random

    class Slow(d.DocumentReader):
        def plain(self, i):
            return None

    def read(reader, html):
        reader.feed(html)
        return reader.finish()

    rng = random.Random(5)
    tags = ["table", "tr", "td", "th", "thead", "ul", "li", "p", "h1", "h2", "nav", "main", "a", "b", "TD", "script", "title", "textarea", "svg", "noscript", "caption", "dl", "dt", "html"]
    others = ["a", "b  c", "\n", "1 & 2", "&lt;b>", "<", "< b", "<!-- <p> -->", "<!doctype html>", "<?x?>", "</>", "<p", "</p ", "<td colspan=2>", '<a href="/x">', "<br/>", '<th rowspan="0">', "x>y"]
    for _ in range(2_000):
        html = "".join(f"<{rng.choice(['', '', '/'])}{rng.choice(tags)}>" if rng.random() < 0.6 else rng.choice(others) for _ in range(rng.randint(1, 30)))
        assert read(d.DocumentReader("u"), html) == read(Slow("u"), html), html


def test_score_tables_search_each_cell_once_and_take_only_places_from_the_reader(spark, tmp_path):
    from claimloom.plans.pages import QUERIES

    spark.range(700).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["score_tables"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("regexp_extract(trim(") == plan.count(r"\bTOEFL\b") - 1 == 1 and "embedded_json" not in plan and "rowspan" not in plan
    assert found.count() == 700 * 3 + sum(20 + k % 120 in range(30, 121) for k in range(700))
