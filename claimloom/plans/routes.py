"""Queries over routing of extractors, scope hints and quoted wording, with SQL that reads each rule its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import intake, routing
from claimloom.sources.tables import table

RESPONSIBILITIES = (*sorted(intake.SOURCE_TYPES), "UNCLASSIFIED", "NEWS", None)
EXTRACTORS = ("tuition", "language", "deadline", "program", "admission", "calendar", None)
HINTS = ("UNIVERSAL", " universal\n", "universal applicants", "", "Mainland China", None)


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def extractor_routes(spark, d):
    """Customers as documents, their orders as claims of responsibility."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("source_ref"), _pick(RESPONSIBILITIES, F.col("o_orderkey") % 18).alias("responsibility"))
    return routing.authorised(o, "o_custkey", "source_ref", "responsibility")


def routing_violations(spark, d):
    l = table(spark, d, "lineitem").select(_pick(RESPONSIBILITIES, F.col("l_partkey") % 18).alias("responsibility"), _pick(EXTRACTORS, F.col("l_suppkey") % 7).alias("extractor"))
    return routing.violations(l, "responsibility", "extractor")


def usable_texts(spark, d):
    return table(spark, d, "documents").groupBy("source", routing.usable(F.col("text")).alias("usable")).agg(F.count("*").alias("documents"))


def page_readers(spark, d):
    k = F.col("page_id")
    payload = F.when(k % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "url")).otherwise(F.concat(F.lit(" "), F.col("html"))).cast("binary")
    kind = _pick(("text/html", " Application/PDF ; q=1", "application/pdfx", None), k % 4)
    return table(spark, d, "pages").select("page_id", routing.reader_of(kind, payload).alias("reader"))


def hinted_scopes(spark, d):
    return table(spark, d, "customer").groupBy(routing.hinted_scope(_pick(HINTS, F.col("c_custkey") % 6)).alias("scope")).agg(F.count("*").alias("hints"))


def suggested_criteria(spark, d):
    k = F.col("p_partkey")
    countries = F.when(k % 3 != 0, F.array(F.lit("GB"), _pick(("CN", "AU", "GB"), k % 3)))
    categories = F.array(_pick(("MATURE", "INTERNATIONAL", "EU", "HOME", None), k % 5), F.lit("TRANSFER"))
    c = routing.suggested_criteria(countries, F.array(F.col("p_brand")), categories)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(c, lambda x: F.concat(x["dimension"], F.lit("="), x["value"])), ";").alias("criteria"))


def quote_places(spark, d):
    """Cuts of a document as blocks; the quote is of the second one, of none, or of the first and third, with its blanks changed."""
    k, cut = F.col("doc_id"), lambda a, n: F.substring("text", a, n)
    quote = F.when(k % 3 == 0, cut(45, 20)).when(k % 3 == 1, F.concat(cut(5, 9), F.lit("#§"))).otherwise(cut(3, 12))
    quote = F.regexp_replace(quote, " ", " \n ")
    place = routing.quote_place(quote, (k % 5 - 1).cast("int"), F.array(cut(1, 40), cut(41, 40), cut(1, 40)))
    return table(spark, d, "documents").select("doc_id", place.alias("place"))


def located_texts(spark, d):
    """Parts as documents of two list items, a paragraph, a table and a link, with locators that hit and miss."""
    k, none = F.col("p_partkey"), lambda t: F.lit(None).cast(t)
    block = lambda c, of: F.struct(c.cast("string").alias("text"), of.alias("list"))
    cell = lambda c: F.struct(c.cast("string").alias("text"))
    rows = F.array(F.array(cell(F.col("p_type")), cell(F.col("p_size"))), F.array(cell(F.col("p_brand"))))
    document = F.struct(
        F.array(block(F.col("p_name"), none("int")), block(F.col("p_brand"), F.lit(0)), block(F.col("p_type"), F.lit(0))).alias("blocks"),
        F.array(F.struct(F.array(F.array(cell(F.lit("Type")), cell(F.lit("Size")))).alias("header_rows"), rows.alias("rows"))).alias("tables"), F.array(cell(F.col("p_name"))).alias("links"),
    )
    i = lambda c: c.cast("int")
    locator = F.struct(
        _pick(("table_cell", "link", "list_item", "block", "span"), k % 5).alias("kind"), i(k % 2 * 0).alias("table_index"), (k % 3 == 0).alias("is_header_row"), i(k % 7 % 3).alias("row_index"), i(k % 4 % 3).alias("column_index"),
        i(k % 2).alias("link_index"), i(k % 3 % 2).alias("list_index"), i(k % 3).alias("list_item_index"), i(k % 4).alias("block_index"), F.when(k % 5 == 4, i(F.lit(2))).alias("char_start"), F.when(k % 10 == 4, i(F.lit(7))).alias("char_end"),
    )
    return table(spark, d, "part").select("p_partkey", routing.located(document, locator).alias("text"))


QUERIES = {f.__name__: f for f in (extractor_routes, routing_violations, usable_texts, page_readers, hinted_scopes, suggested_criteria, quote_places, located_texts)}

_NAMES = "['ACADEMIC_CALENDAR', 'APPLICATION_DEADLINES', 'AUTHORIZED_RANKING', 'ENTRY_REQUIREMENTS', 'FACULTY_OR_SCHOOL', 'GOVERNMENT', 'LANGUAGE_REQUIREMENTS', 'OFFICIAL_PDF', 'PHD_ADMISSIONS', 'POSTGRADUATE_ADMISSIONS', 'PROGRAM_CATALOG', 'PROGRAM_PAGE', 'TUITION_FEES', 'UNDERGRADUATE_ADMISSIONS', 'UNIVERSITY_HOME', 'UNCLASSIFIED', 'NEWS', null]"
_ROUTE = """with route(responsibility, extractor) as (values ('TUITION_FEES', 'tuition'), ('ACADEMIC_CALENDAR', 'calendar'), ('PROGRAM_CATALOG', 'program'), ('PROGRAM_PAGE', 'program'),
  ('APPLICATION_DEADLINES', 'deadline'), ('UNDERGRADUATE_ADMISSIONS', 'deadline'), ('POSTGRADUATE_ADMISSIONS', 'deadline'), ('PHD_ADMISSIONS', 'deadline'),
  ('PROGRAM_PAGE', 'admission'), ('ENTRY_REQUIREMENTS', 'admission'), ('UNDERGRADUATE_ADMISSIONS', 'admission'), ('POSTGRADUATE_ADMISSIONS', 'admission'), ('PHD_ADMISSIONS', 'admission'),
  ('LANGUAGE_REQUIREMENTS', 'language'), ('PROGRAM_PAGE', 'language'), ('ENTRY_REQUIREMENTS', 'language'), ('UNDERGRADUATE_ADMISSIONS', 'language'), ('POSTGRADUATE_ADMISSIONS', 'language'), ('PHD_ADMISSIONS', 'language'))
"""
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _folded(said):
    return f"trim(regexp_replace({said}, '{_SPACE}', ' ', 'g'), ' ')"


ORACLE_SQL = {
    "extractor_routes": _ROUTE + f""", c as (select o_custkey, o_orderkey, {_NAMES}[o_orderkey % 18 + 1] as responsibility from orders)
select o_custkey, extractor, min(o_orderkey) as source_ref, arg_min(responsibility, o_orderkey) as responsibility from c join route using (responsibility) group by o_custkey, extractor""",
    "routing_violations": _ROUTE + f""", c as (select {_NAMES}[l_partkey % 18 + 1] as responsibility, ['tuition', 'language', 'deadline', 'program', 'admission', 'calendar', null][l_suppkey % 7 + 1] as extractor from lineitem)
select responsibility, extractor, count(*) as claims from c where not exists (select 1 from route r where r.responsibility = c.responsibility and r.extractor = c.extractor) group by all""",
    "usable_texts": "select source, length(coalesce(text, '')) > 399 as usable, count(*) as documents from documents group by all",
    "page_readers": "select page_id, case when page_id % 3 = 0 or page_id % 4 = 1 then 'pdf' else 'html' end as reader from pages",
    "hinted_scopes": "select case when c_custkey % 6 < 2 then 'UNIVERSAL' else 'SCOPE_MAPPING_REQUIRED' end as scope, count(*) as hints from customer group by 1",
    "suggested_criteria": """select p_partkey, concat_ws(';', case p_partkey % 3 when 1 then 'applicant_country=AU;applicant_country=GB' when 2 then 'applicant_country=GB' end, 'qualification_type=' || p_brand,
  case p_partkey % 5 when 1 then 'residency_status=INTERNATIONAL' when 3 then 'residency_status=HOME' end) as criteria from part""",
    "quote_places": f"""with q as (select doc_id, doc_id % 5 - 1 as cited, {_folded("substr(text, 1, 40)")} as a, {_folded("substr(text, 41, 40)")} as b,
  {_folded("case doc_id % 3 when 0 then substr(text, 45, 20) when 1 then substr(text, 5, 9) || '#§' else substr(text, 3, 12) end")} as said from documents)
select doc_id, cast(case when said = '' then null when cited in (0, 2) and contains(a, said) then cited when cited = 1 and contains(b, said) then 1 when contains(a, said) then 0 when contains(b, said) then 1 end as int) as place from q""",
    "located_texts": """select p_partkey, case p_partkey % 5
  when 0 then case when p_partkey % 3 = 0 then case when p_partkey % 7 % 3 = 0 then ['Type', 'Size'][p_partkey % 4 % 3 + 1] end else case p_partkey % 7 % 3 when 0 then [p_type, cast(p_size as varchar)][p_partkey % 4 % 3 + 1] when 1 then [p_brand][p_partkey % 4 % 3 + 1] end end
  when 1 then case when p_partkey % 2 = 0 then p_name end when 2 then case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 2 then null end
  when 3 then [p_name, p_brand, p_type][p_partkey % 4 + 1] else case when p_partkey % 10 = 4 then substr([p_name, p_brand, p_type][p_partkey % 4 + 1], 3, 5) else [p_name, p_brand, p_type][p_partkey % 4 + 1] end end as text from part""",
}
