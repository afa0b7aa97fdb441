"""Queries over nested documents and over sentences that are made from numeric columns, so that SQL can tell what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import documents, extract, nested, scopes
from claimloom.sources.tables import spread, table


def _docs(spark, d):
    return documents.documents(table(spark, d, "pages"))


def page_parts(spark, d):
    return documents.statistics(_docs(spark, d)).select("page_id", "headings", "scripts", "tables", "status")


def document_statistics(spark, d):
    return documents.statistics(_docs(spark, d))


def html_links(spark, d):
    return documents.links(_docs(spark, d))


def link_hosts(spark, d):
    """Links, and pages with links, inside and outside of page chrome."""
    return html_links(spark, d).groupBy("in_chrome").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


def html_blocks(spark, d):
    return _docs(spark, d).select("page_id", F.posexplode("blocks").alias("place", "b")).select("page_id", "place", "b.*")


def link_profiles(spark, d):
    return documents.link_profiles(_docs(spark, d))


def heading_paths(spark, d):
    return documents.sections(_docs(spark, d))


def document_bodies(spark, d):
    return documents.distinct_bodies(_docs(spark, d))


def visible_texts(spark, d):
    t = documents.visible_text(F.col("blocks"))
    return _docs(spark, d).select("page_id", F.length(t).cast("long").alias("n"), (F.length(t) >= 400).alias("usable"))


def _said(rows, key, text):
    """Sentences as statements of one body paragraph each."""
    none = F.lit(None).cast("string")
    return spread(rows).select(F.col(key).alias("page_id"), F.lit(0).alias("place"), F.lit("p").alias("kind"), text.alias("text"), none.alias("heading"), none.alias("column_header"), none.alias("row_label"))


def fee_sentences(spark, d):
    k, a = F.col("p_partkey"), 1000 + F.col("p_partkey") % 90000
    n = lambda c: F.concat(F.lit("£"), F.format_number(c, 0))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Tuition fee "), n(a), F.lit(" per year for international students"))).when(k % 5 == 1, F.concat(F.lit("Tuition fees "), n(a), F.lit(" – "), n(a + 500), F.lit(" per semester for home students")))
        .when(k % 5 == 2, F.concat(F.lit("Fees up to "), n(a), F.lit(" in total"))).when(k % 5 == 3, F.concat(F.lit("Fees "), n(a + 500), F.lit(" to "), n(a), F.lit(" per module for EU students"))).otherwise(F.lit("The fee varies by course"))
    )
    return extract.fees(_said(table(spark, d, "part"), "p_partkey", text)).select("page_id", "shape", "amount_min", "amount_max", "currency", "unit", "students", F.array_join("unresolved", ",").alias("unresolved"))


def _made(rows, key, html):
    return documents.documents(spread(rows).select(F.col(key).alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html")), documents.PLACED)


def fee_tables(spark, d):
    """Fee tables made from parts, read as pages: a cell is understood with its column header and row label."""
    k = F.col("p_partkey")
    row = F.concat(F.lit("<tr><th>International students<td>"), F.format_number(1000 + k % 90000, 0), F.lit("<td>n/a"))
    html = F.concat(F.lit("<h2>Fees</h2><table><thead><tr><th>Students<th>Tuition fee (GBP) per year<th>Note</thead>"), row, F.lit("</table>"))
    return extract.fees(documents.statements(_made(table(spark, d, "part"), "p_partkey", html))).select("page_id", "shape", "amount_min", "currency", "unit", "students", "money_kind", "band")


def _grid_page():
    """A page whose table has two header rows, a label over two rows and, for every third part, a fee over two columns."""
    k = F.col("p_partkey")
    n = lambda c: F.format_number(c, 0)
    last = F.when(k % 3 == 0, F.concat(F.lit("<td colspan=2>"), n(3000 + k % 7000))).otherwise(F.concat(F.lit("<td>"), n(3000 + k % 7000), F.lit("<td>"), n(4000 + k % 7000)))
    return F.concat(
        F.lit("<h1>Money</h1><h2>Tuition</h2><table><thead><tr><th rowspan=2>Award<th rowspan=2>Pace<th colspan=2>Fee per year<tr><th>Home<th>Overseas</thead><tr><td rowspan=2>"), F.col("p_name"),
        F.lit("<td>Full<td>"), n(1000 + k % 7000), F.lit("<td>"), n(2000 + k % 7000), F.lit("<tr><td>Part"), last, F.lit("</table><h2>Housing</h2><p>Fees: pay £"), n(5000 + k % 900), F.lit(" for rent"),
    )


def table_places(spark, d):
    """Every place of these tables with its header and label, spans laid out."""
    c = documents.cells(_made(table(spark, d, "part"), "p_partkey", _grid_page()))
    return c.select("page_id", "row_index", "column_index", "text", "origin", "column_header", "row_label", "heading")


def page_fees(spark, d):
    """Fees of these pages, cells and sentences, each with what the money is for."""
    f = extract.fees(documents.statements(_made(table(spark, d, "part"), "p_partkey", _grid_page())))
    return f.select("page_id", "amount_min", "unit", "students", "money_kind", "band")


def score_tables(spark, d):
    """Scores in tables made from parts: overall and component columns, a row without a test, a value off the scale."""
    k, x = F.col("p_partkey"), F.format_number(4 + (F.col("p_partkey") % 11) / 2, 1)
    html = F.concat(
        F.lit("<h2>English</h2><table><thead><tr><th>Test<th>Overall score<th>Writing<th>Notes</thead><tr><td>IELTS Academic<td>"), x, F.lit("<td>6.0<td>7.0<tr><td>TOEFL iBT<td>"), (20 + k % 120).cast("string"),
        F.lit("<td>22<td>x<tr><td>Other<td>7.5<td>7.0<td></table>"),
    )
    c = documents.cells(_made(table(spark, d, "part"), "p_partkey", html))
    return extract.score_cells(c).select("page_id", "test", "kind", "skill", "value", "row_index", "column_index")


def money_kinds(spark, d):
    """What an amount is for, by labels, nearest wording and headings, in lines of several amounts without blanks between them."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    text = F.when(k % 5 == 0, "Tuition$56,550Fees$5,126Housing$12,922Food$8,268").when(k % 5 == 1, "Pay 8,268 for meals; your room is 12,922").when(k % 5 == 2, "12,922 a year").when(k % 5 == 3, "books 5,126, travel 8,268").otherwise("5,126 in all")
    amount = F.element_at(F.array(*[F.lit(x) for x in ("56,550", "12,922", "8,268")]), (k % 3 + 1).cast("int"))
    column, row = F.when(k % 7 == 0, "Registration fee"), F.when(k % 7 == 1, "Total cost of living costs")
    headings = F.array(F.lit("Costs"), F.when(k % 2 == 0, "Accommodation").otherwise("More"), F.lit("Amounts"))
    kind = extract.money_kind(column, row, text, amount, headings)
    return table(spark, d, "lineitem").groupBy((k % 5).alias("wording"), (k % 3).alias("amount"), (k % 7).alias("label"), (k % 2).alias("heading"), kind.alias("kind")).agg(F.count("*").alias("n"))


def deadline_sentences(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d MMMM yyyy")
    text = F.when(k % 4 == 0, "We accept applications on a rolling basis").when(k % 4 == 1, "Applications are closed for this year").when(k % 4 == 2, F.concat(F.lit("Applications close; deadline "), day)).otherwise(F.concat(F.lit("Apply by "), day, F.lit(" at the latest")))
    return extract.deadlines(_said(table(spark, d, "orders"), "o_orderkey", text)).select("page_id", "state", "year", "month", "day")


def score_sentences(spark, d):
    x = F.format_number(5 + (F.col("p_size") % 8) / 2, 1)
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("IELTS "), x, F.lit(" overall with no less than 5.5 in each component"))).otherwise(F.concat(F.lit("TOEFL score of "), (80 + F.col("p_size") % 30).cast("string")))
    return extract.english_scores(_said(table(spark, d, "part"), "p_partkey", text)).select("page_id", "test", "kind", "value")


_SCOPED = ["{a} applicants", "Applicants from {n}", "students who are based in the {n}", "Results obtained in {n}", "If you are from {n}", "the {n} Leaving Certificate", "{a} medicine", "a campus in {n}"]
_NEGATED = ["", "non-", "other than ", "all "]
_PLACE_WORDS = [("China", "Chinese", "CN"), ("Hong Kong", "Hong Kong", "HK"), ("India", "Indian", "IN"), ("Singapore", "Singaporean", "SG"), ("Malaysia", "Malaysian", "MY"), ("United States", "American", "US"), ("EU", "EU", "EU")]


def jurisdiction_scopes(spark, d):
    """Places in sentences made from order lines: every construction, with and without a negation, for every place, and sentences that only name one."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    place = F.col("l_partkey")
    text = F.replace(F.replace(pick(_SCOPED, k), F.lit("{a}"), pick([a for _, a, _ in _PLACE_WORDS], place)), F.lit("{n}"), pick([n for n, _, _ in _PLACE_WORDS], place))
    j = scopes.jurisdictions(F.concat(F.lit("We note: "), pick(_NEGATED, F.col("l_suppkey")), text, F.lit(", please.")))
    found = table(spark, d, "lineitem").select(F.explode(j).alias("j"))
    return found.groupBy("j.code", "j.construction").agg(F.count("*").alias("n"))


def admission_requirements(spark, d):
    """Requirements of pages made from parts: whom they are about, systems, level and discipline, from the statement or its heading."""
    k = F.col("p_partkey")
    said = F.when(k % 5 == 0, "Applicants from India must have 80%").when(k % 5 == 1, "A levels at grade A are required in computing").when(k % 5 == 2, "You need a bachelor's degree").when(k % 5 == 3, "Applicants from China are welcome").otherwise("Chinese students need the gaokao, not US students")
    html = F.concat(F.lit("<h1>"), F.when(k % 2 == 0, "MSc Engineering").otherwise("About"), F.lit("</h1><p>"), said, F.lit("</p><nav><p>You must have A levels</p></nav>"))
    r = scopes.admission_requirements(documents.statements(_made(table(spark, d, "part"), "p_partkey", html)))
    return r.select("page_id", F.array_join(F.transform("jurisdictions", lambda x: x["code"]), ",").alias("codes"), F.array_join("systems", ",").alias("systems"), "level", "discipline", "scope")


def _outlined_page():
    """A page of a part: menu with a link, headings of three levels, a list, a paragraph that is one link and one that holds one, a footer heading."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    return F.concat(
        F.lit('<html lang="en"><title>Part '), k, F.lit('</title><nav><ul><li><a href="/menu">Menu</a></ul></nav><h1>'), name, F.lit("</h1><p>Size <b>"), F.col("p_size").cast("string"), F.lit('</b><h3>Deep</h3><ul><li>one<li>two</ul><h2>Next</h2><p><a href="p'), k,
        F.lit('.pdf">all of it</a><p>See <a href="https://other.edu/x">this</a> page', ), F.when(F.col("p_partkey") % 3 == 0, "<h1>Last</h1>tail").otherwise(""), F.lit("<footer><h2>Foot</h2></footer></html>"),
    )


def _outlined(spark, d):
    url = F.concat(F.lit("https://a.edu/dir/"), F.col("p_partkey").cast("string"))
    return documents.documents(spread(table(spark, d, "part")).select(F.col("p_partkey").alias("page_id"), url.alias("url"), _outlined_page().alias("html")))


def outlined_blocks(spark, d):
    """Blocks of these pages in order, with what they stand in."""
    b = _outlined(spark, d).select("page_id", F.posexplode("blocks").alias("place", "b"))
    return b.select("page_id", "place", "b.kind", "b.text", "b.level", "b.container", "b.in_chrome", "b.ordered")


def outlined_paths(spark, d):
    """Blocks outside chrome with the headings over them."""
    return documents.sections(_outlined(spark, d)).select("page_id", "place", "text", F.array_join("heading_path", " > ").alias("path"))


def outlined_links(spark, d):
    """Links of these pages beside the share of their block's text that is theirs."""
    return documents.profiled_links(_outlined(spark, d)).select("page_id", "text", "resolved", "host", "is_pdf", "in_chrome", "text_fraction", "is_link_only")


def outlined_texts(spark, d):
    """Title, language, visible text and status of these pages, and whether their digest is one of their own."""
    docs = _outlined(spark, d)
    text = documents.visible_text(F.col("blocks"))
    return docs.select("page_id", "title", "language", F.sha2(text, 256).alias("text_sha256"), F.size("links").alias("links"), F.col("error").isNull().alias("read"))


def _event_json(spark, d):
    n = F.col("event_id")
    body = F.concat(
        F.lit('{"props": '), "props", F.lit(', "list": [1, '), "props", F.lit(', [null, true, "event '), n.cast("string"), F.lit('"]], "long": "'), F.repeat(F.lit("x"), (n % 80).cast("int")), F.lit('", "none": {}, "rate": 2.5}'),
    )
    return table(spark, d, "events").select("event_id", F.when(n % 10 == 0, F.lit('{"props": [')).when(n % 10 == 1, None).otherwise(body).alias("body"))


def json_values(spark, d):
    """Values at any depth of JSON made from events, malformed ones among them, by path and kind."""
    return nested.json_values(_event_json(spark, d), "event_id", "body").groupBy("path", "depth", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


def embedded_texts(spark, d):
    """Events whose JSON holds long strings, and malformed JSON."""
    rows = _event_json(spark, d)
    bad = nested.malformed(rows, "event_id", "body").select("event_id", F.lit(-1).cast("long").alias("texts"), F.lit(0).cast("long").alias("characters"))
    return nested.embedded_texts(rows, "event_id", "body").unionByName(bad)


QUERIES = {f.__name__: f for f in (outlined_blocks, outlined_paths, outlined_links, outlined_texts, json_values, embedded_texts, jurisdiction_scopes, admission_requirements, page_parts, document_statistics, html_links, link_hosts, html_blocks, link_profiles, heading_paths, document_bodies, visible_texts, fee_sentences, fee_tables, deadline_sentences, score_sentences, table_places, page_fees, score_tables, money_kinds)}

_COUNT = "len(regexp_extract_all(coalesce(html, ''), '{}'))"
#: Places of the made tables: rows 0 and 1 by columns 0 to 3, ``n`` the fee there.
_GRID = """with g as (select p_partkey as k, p_name, r, c, format('{:,}', (case when r = 1 and c = 3 and p_partkey % 3 = 0 then 3000 else 1000 * (2 * r + c - 1) end + p_partkey % 7000)::bigint) as n
  from part, (values (0), (1)) rows(r), (values (0), (1), (2), (3)) columns(c))
"""
_EVENT_JSON = """with j as (select event_id, case when event_id % 10 > 1 then '{"props": ' || props || ', "list": [1, ' || props || ', [null, true, "event ' || event_id || '"]], "long": "' || repeat('x', (event_id % 80)::int) || '", "none": {}, "rate": 2.5}' end as body from events),
v as (select event_id, regexp_replace(t.fullkey, '\\.([a-z]+)', '[''\\1'']', 'g') as path, case t.type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind,
  case when t.type = 'VARCHAR' then json_extract_string(t.atom, '$') when t.type not in ('OBJECT', 'ARRAY', 'NULL') then cast(t.atom as varchar) end as text from j, json_tree(j.body) t where body is not null)
"""
#: Blocks of the outlined pages in order: kind, text, level, container, whether in chrome, path of headings (outside chrome).
_OUTLINE = """with b as (select p_partkey as page_id, p_name, x.* from part, lateral (select unnest([
  {'kind': 'li', 'text': 'Menu', 'level': null, 'container': 'nav', 'path': ''}, {'kind': 'h1', 'text': p_name, 'level': 1, 'container': null, 'path': p_name}, {'kind': 'p', 'text': 'Size ' || p_size, 'level': null, 'container': null, 'path': p_name},
  {'kind': 'h3', 'text': 'Deep', 'level': 3, 'container': null, 'path': p_name || ' > Deep'}, {'kind': 'li', 'text': 'one', 'level': null, 'container': null, 'path': p_name || ' > Deep'}, {'kind': 'li', 'text': 'two', 'level': null, 'container': null, 'path': p_name || ' > Deep'},
  {'kind': 'h2', 'text': 'Next', 'level': 2, 'container': null, 'path': p_name || ' > Next'}, {'kind': 'p', 'text': 'all of it', 'level': null, 'container': null, 'path': p_name || ' > Next'}, {'kind': 'p', 'text': 'See this page', 'level': null, 'container': null, 'path': p_name || ' > Next'},
  {'kind': 'h1', 'text': 'Last', 'level': 1, 'container': null, 'path': 'Last'}, {'kind': 'p', 'text': 'tail', 'level': null, 'container': null, 'path': 'Last'}, {'kind': 'h2', 'text': 'Foot', 'level': 2, 'container': 'footer', 'path': ''}]) as s, unnest(range(12)) as i) x),
n as (select page_id, s, i, row_number() over (partition by page_id order by i) - 1 as place from b where page_id % 3 = 0 or i not in (9, 10))
"""
ORACLE_SQL = {
    "outlined_blocks": _OUTLINE + "select page_id, place, s.kind as kind, s.text as text, s.level as level, s.container as container, s.container is not null as in_chrome, case when s.kind = 'li' then false end as ordered from n",
    "outlined_paths": _OUTLINE + "select page_id, row_number() over (partition by page_id order by place) - 1 as place, s.text as text, s.path as path from n where s.container is null",
    "outlined_links": """select p_partkey as page_id, x.* from part, lateral (select unnest(['Menu', 'all of it', 'this']) as text, unnest(['https://a.edu/menu', 'https://a.edu/dir/p' || p_partkey || '.pdf', 'https://other.edu/x']) as resolved, unnest(['a.edu', 'a.edu', 'other.edu']) as host,
  unnest([false, true, false]) as is_pdf, unnest([true, false, false]) as in_chrome, unnest([1.0, 1.0, 0.308]::double[]) as text_fraction, unnest([true, true, false]) as is_link_only) x""",
    "outlined_texts": _OUTLINE + "select page_id, 'Part ' || page_id as title, 'en' as language, sha256(string_agg(s.text, chr(10) order by place) filter (s.container is null)) as text_sha256, 3 as links, true as read from n group by page_id",
    "json_values": _EVENT_JSON + "select path, len(regexp_extract_all(path, '\\[')) as depth, kind, count(*) as n, cast(sum(length(text)) as bigint) as characters from v group by path, kind",
    "embedded_texts": _EVENT_JSON + """select event_id, count(*) filter (kind = 'string' and length(text) >= 40) as texts, cast(coalesce(sum(length(text)) filter (kind = 'string' and length(text) >= 40), 0) as bigint) as characters from v group by event_id
union all select event_id, -1, 0 from events where event_id % 10 = 0""",
    "jurisdiction_scopes": """with l as (select (l_orderkey * 8 + l_linenumber) % 8 as c, l_partkey % 7 as p, l_suppkey % 4 as n from lineitem)
select ['CN', 'HK', 'IN', 'SG', 'MY', 'US', 'EU'][p + 1] as code, ['DEMONYM', 'APPLICANT_ORIGIN', 'APPLICANT_ORIGIN', 'QUALIFICATION_ORIGIN', 'CONDITIONAL_ORIGIN', 'NATIONAL_QUALIFICATION'][c + 1] as construction, count(*) as n
from l where c < 6 and (n in (0, 3) or c = 5) group by all""",
    "admission_requirements": """select p_partkey as page_id, ['IN', '', '', '', 'CN'][p_partkey % 5 + 1] as codes, ['', 'A-level', '', '', 'Gaokao'][p_partkey % 5 + 1] as systems,
  case when p_partkey % 5 = 2 then 'BACHELOR' when p_partkey % 2 = 0 then 'MASTER' end as level, case when p_partkey % 5 = 1 then 'COMPUTER_AND_DATA' when p_partkey % 2 = 0 then 'ENGINEERING' end as discipline,
  ['JURISDICTION', 'QUALIFICATION_SYSTEM', 'UNSTATED', '', 'JURISDICTION'][p_partkey % 5 + 1] as scope from part where p_partkey % 5 <> 3""",
    "page_parts": f"select page_id, {_COUNT.format('<h[1-6]>')} as headings, {_COUNT.format('<script')} as scripts, {_COUNT.format('<table')} as tables, 'OK' as status from pages",
    "link_hosts": f"select true as in_chrome, cast(sum(n) as bigint) as links, count(*) filter (n > 0) as pages from (select {_COUNT.format('<a ')} as n from pages) having sum(n) > 0",
    "fee_sentences": """with p as (select p_partkey as k, 1000.0 + p_partkey % 90000 as a from part) select k as page_id, ['EXACT', 'RANGE', 'UP_TO', 'AMBIGUOUS', 'VARIABLE'][k % 5 + 1] as shape, case k % 5 when 0 then a when 1 then a when 3 then a + 500 end::double as amount_min,
  case k % 5 when 0 then a when 1 then a + 500 when 2 then a when 3 then a end::double as amount_max, case when k % 5 < 4 then 'GBP' end as currency, ['PER_YEAR', 'PER_SEMESTER', 'TOTAL_PROGRAM', 'PER_MODULE', null][k % 5 + 1] as unit, ['INTERNATIONAL', 'HOME', null, 'EU', null][k % 5 + 1] as students,
  ['', '', 'STUDENT_CATEGORY_UNRESOLVED', 'AMOUNT_SHAPE_AMBIGUOUS', 'CURRENCY_ABSENT,BILLING_UNIT_UNRESOLVED,STUDENT_CATEGORY_UNRESOLVED'][k % 5 + 1] as unresolved from p""",
    "fee_tables": "select p_partkey as page_id, 'EXACT' as shape, (1000 + p_partkey % 90000)::double as amount_min, 'GBP' as currency, 'PER_YEAR' as unit, 'INTERNATIONAL' as students, 'TUITION_FEE' as money_kind, 'HIGH' as band from part",
    "table_places": _GRID + """select k as page_id, r as row_index, c as column_index, case c when 0 then p_name when 1 then ['Full', 'Part'][r + 1] else n end as text,
  not (c = 0 and r = 1) and not (c = 3 and r = 1 and k % 3 = 0) as origin, ['Award', 'Pace', 'Fee per year Home', 'Fee per year Overseas'][c + 1] as column_header,
  case c when 0 then null when 1 then p_name else p_name || ' ' || ['Full', 'Part'][r + 1] end as row_label, 'Tuition' as heading from g""",
    "page_fees": _GRID + """select k as page_id, replace(n, ',', '')::double as amount_min, 'PER_YEAR' as unit, ['HOME', 'OVERSEAS'][c - 1] as students, 'TUITION_FEE' as money_kind, 'HIGH' as band from g where c > 1 and not (c = 3 and r = 1 and k % 3 = 0)
union all select p_partkey, 5000.0 + p_partkey % 900, null, null, 'HOUSING', 'LOW' from part""",
    "score_tables": """with p as (select p_partkey as k, 4 + (p_partkey % 11) / 2.0 as x, 20 + p_partkey % 120 as t from part)
select k as page_id, 'IELTS' as test, 'OVERALL' as kind, null::varchar as skill, x::double as value, 0 as row_index, 1 as column_index from p union all select k, 'IELTS', 'COMPONENT', 'writing', 6.0, 0, 2 from p
union all select k, 'TOEFL', 'OVERALL', null, t, 1, 1 from p where t between 30 and 120 union all select k, 'TOEFL', 'COMPONENT', 'writing', 22.0, 1, 2 from p""",
    "money_kinds": """with l as (select (l_orderkey + l_linenumber) % 5 as w, (l_orderkey + l_linenumber) % 3 as a, (l_orderkey + l_linenumber) % 7 as b, (l_orderkey + l_linenumber) % 2 as h from lineitem)
select w as wording, a as amount, b as label, h as heading, case when b = 0 then 'OTHER_MANDATORY_FEE' when b = 1 then 'ESTIMATED_TOTAL_COST'
  when w = 0 then ['TUITION_FEE', 'HOUSING', 'MEAL_PLAN'][a + 1] when w = 1 then ['MEAL_PLAN', 'HOUSING', 'MEAL_PLAN'][a + 1] when w = 3 then 'COST_OF_ATTENDANCE_COMPONENT' when h = 0 then 'HOUSING' else 'UNKNOWN_FINANCIAL_AMOUNT' end as kind, count(*) as n
from l group by all""",
    "deadline_sentences": "select o_orderkey as page_id, ['ROLLING', 'CLOSED', 'DATE', 'DATE'][o_orderkey % 4 + 1] as state, case when o_orderkey % 4 > 1 then year(o_orderdate) end as year, case when o_orderkey % 4 > 1 then month(o_orderdate) end as month, case when o_orderkey % 4 > 1 then day(o_orderdate) end as day from orders",
    "score_sentences": """select p_partkey as page_id, 'IELTS' as test, 'OVERALL' as kind, 5 + (p_size % 8) / 2.0::double as value from part where p_partkey % 2 = 0 union all select p_partkey, 'IELTS', 'COMPONENT_MINIMUM', 5.5 from part where p_partkey % 2 = 0
union all select p_partkey, 'TOEFL', 'OVERALL', 80.0 + p_size % 30 from part where p_partkey % 2 = 1""",
}
