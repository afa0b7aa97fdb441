"""Queries over records of fetches, intake of sources and counts for reviewers, with SQL that reads each rule its own way.

The views give the driver's rows the shape that the operators want; the SQL states what they must come to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import records
from claimloom.functions.urls import canonical
from claimloom.operators import intake, review
from claimloom.sources.tables import table

PARAMETERS = ("token=s3cret", "q=a+b", "SID=x&code=", "tree=2%2C0&key=%zz")
REGIONS = ("英国", "美国", " 中国香港 ", "澳门", "法国", "")
TERRITORIES = ("United Kingdom", "United States", "Hong Kong SAR", "France", None)


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def redacted_urls(spark, d):
    u = F.concat(F.substring_index("url", "#", 1), F.when(F.col("url").contains("?"), "&").otherwise("?"), _pick(PARAMETERS, F.col("page_id") % 4))
    return table(spark, d, "pages").select("page_id", records.redacted(u).alias("url"))


def kept_headers(spark, d):
    i = F.col("page_id").cast("string")
    h = F.create_map(F.lit("ETag"), i, F.lit("Set-Cookie"), i, F.lit("X-Trace"), i, F.lit("server"), F.repeat(F.lit("s"), (F.col("page_id") % 2 * 1000 + 1).cast("int")))
    kept = records.kept_headers(F.when(F.col("page_id") % 5 == 0, F.create_map(F.lit("Authorization"), i)).otherwise(h))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("headers"))


def destinations(spark, d):
    k = F.col("c_custkey")
    at = records.destination(_pick(REGIONS, k % 6), _pick(TERRITORIES, k % 5))
    return table(spark, d, "customer").groupBy(at["code"].alias("code"), at["problem"].alias("problem")).agg(F.count("*").alias("targets"))


def claim_fingerprints(spark, d):
    n = F.col("l_linenumber")
    locator = {"kind": F.when(n % 2 == 0, "table_cell").otherwise("block"), "block_index": n, "row_index": F.when(n % 2 == 0, F.col("l_suppkey")), "heading_path": F.array(F.lit("Fees – §"), F.col("l_returnflag"))}
    f = records.claim_fingerprint(F.col("l_orderkey"), F.lit("TUITION"), locator, F.lit("rule"), F.lit("1.0"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", f.alias("fingerprint"))


def body_places(spark, d):
    k = F.col("p_partkey")
    place = records.body_confirmation(F.when(k % 7 == 0, "link").otherwise("block"), _pick(("main", "article", "aside", "form", "nav", None), k % 6))
    return table(spark, d, "part").groupBy(place.alias("confirmation")).agg(F.count("*").alias("claims"))


def registered_sources(spark, d):
    """Pages as claims on an address of their site, so that many claims meet on one source; every tenth page is a source already known."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^([^/]+//[^/]+)/", 1).alias("site"))
    c = canonical(F.concat("site", F.when(F.length("site") % 5 == 0, "/f.PDF").when(F.length("site") % 5 == 1, ":9/").otherwise("/")))
    u = F.concat("site", F.when(F.length("site") % 5 == 0, "/f.PDF").when(F.length("site") % 5 == 1, ":9/").otherwise("/"))
    claims = p.select(F.sha2(u, 256).alias("url_hash"), u.alias("url"), F.col("page_id").alias("source_ref"), _pick([*sorted(intake.SOURCE_TYPES), "NEWS", None], F.col("page_id") % 17).alias("category"), c["rejection"].alias("rejection"))
    return intake.registered(claims, claims.filter(F.col("source_ref") % 10 == 3))


def recovered_sources(spark, d):
    e, i = table(spark, d, "events"), F.col("source_id")
    s = e.select(F.col("user_id").alias("source_id")).distinct().select(
        i, (i % 4 != 0).alias("is_active"), F.when(i % 3 == 0, "BLOCKED").otherwise("FETCHABLE").alias("fetch_eligibility"), F.when(i % 3 == 0, "BLOCKED").otherwise("OK").alias("access_state"),
        F.when(i % 2 == 0, F.lit("2024-02-01").cast("date")).alias("cooldown_until"))
    kind = F.when(F.col("event_type") == "error", "DISABLE").when(F.col("event_type") == "signup", "REENABLE").when(F.col("event_id") % 3 == 0, "NEEDS_REVIEW").otherwise("CLEAR_COOLDOWN")
    return intake.recovered(s, e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("action_id"), kind.alias("action")))


def deadline_contexts(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("Round "), (k % 9).cast("string"), F.lit(" closes in 2026/27"))).when(k % 6 == 1, "January 4 for Regular Decision").when(k % 6 == 2, "Apply by May").when(k % 6 == 3, "Applications for 2027 entry").when(k % 6 == 4, "Restrictive Early Action, then Regular Decision").otherwise("Nothing stated")
    heading = F.when(k % 6 == 1, "Early Action").when(k % 6 == 2, "Priority dates 2026–27").when(k % 6 == 5, "Fees")
    c = intake.deadline_context(text, heading)
    return table(spark, d, "orders").select("o_orderkey", *[v.alias(n) for n, v in c.items()])


def _lines(spark, d):
    old = F.col("l_linenumber") == 7
    decision = F.when(F.col("l_returnflag") == "A", "ACCEPTED").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("UNREVIEWED")
    b = review.blockers(old, decision, F.when(F.col("l_partkey") % 9 == 0, "UNVERIFIED").otherwise("OFFICIAL_VERIFIED"), F.col("l_discount") > 0.08, F.col("l_quantity") > 45, F.col("l_tax") < 0.08)
    return table(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 4).alias("kind"), b.alias("blockers"))


def blocker_matrix(spark, d):
    return intake.blocker_matrix(_lines(spark, d), "l_suppkey", "kind", "blockers")


def scope_vocabulary(spark, d):
    scope = lambda m, k: F.struct(m.alias("marker"), F.lit(k).alias("kind"))
    scopes = F.array_compact(F.array(F.when(F.col("o_orderstatus") != "P", scope(F.col("o_orderpriority"), "PRIORITY")), F.when(F.col("o_totalprice") > 250000, scope(F.col("o_orderstatus"), "STATUS"))))
    o = table(spark, d, "orders").select(scopes.alias("scopes"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("said"), "o_orderkey")
    return intake.scope_vocabulary(o, "scopes", "said", "o_orderkey")


def responsibility_counts(spark, d):
    """Claimed kinds of page by scope: pages, those pending."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source_type"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3).alias("degree_scope"))
    return o.agg(F.count("*").alias("pages"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


def responsibility_fanout(spark, d):
    """How many pages have how many kinds."""
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"))
    return per.groupBy("kinds").agg(F.count("*").alias("pages"))


QUERIES = {f.__name__: f for f in (
    redacted_urls, kept_headers, destinations, claim_fingerprints, body_places, registered_sources, recovered_sources, deadline_contexts, blocker_matrix, scope_vocabulary, responsibility_counts, responsibility_fanout,
)}

_BLOCKED = """with x as (select l_suppkey, l_linenumber % 4 as kind, l_linenumber = 7 as b1, case l_returnflag when 'A' then null when 'R' then 'REJECTED' else 'UNREVIEWED' end as b2, l_partkey % 9 = 0 as b3, l_discount > 0.08 as b4, l_quantity > 45 as b5, not l_tax < 0.08 as b6 from lineitem),
y as (select *, not (b1 or b2 is not null or b3 or b4 or b5 or b6) as ready from x)
"""
_ONE = "select l_suppkey, '{0}' as dimension, {1} as key, count(*) as claims from y {2} group by all"
_KINDS = "['ACADEMIC_CALENDAR', 'APPLICATION_DEADLINES', 'AUTHORIZED_RANKING', 'ENTRY_REQUIREMENTS', 'FACULTY_OR_SCHOOL', 'GOVERNMENT', 'LANGUAGE_REQUIREMENTS', 'OFFICIAL_PDF', 'PHD_ADMISSIONS', 'POSTGRADUATE_ADMISSIONS', 'PROGRAM_CATALOG', 'PROGRAM_PAGE', 'TUITION_FEES', 'UNDERGRADUATE_ADMISSIONS', 'UNIVERSITY_HOME', 'NEWS']"

ORACLE_SQL = {
    "redacted_urls": """select page_id, split_part(url, '#', 1) || case when contains(url, '?') then '&' else '?' end
  || case page_id % 4 when 0 then 'token=%5Bredacted%5D' when 1 then 'q=a+b' when 2 then 'SID=%5Bredacted%5D&code=%5Bredacted%5D' else 'tree=2%2C0&key=%5Bredacted%5D' end as url from pages""",
    "kept_headers": "select page_id, case when page_id % 5 <> 0 then 'ETag=' || page_id || ';server=' || repeat('s', case when page_id % 2 = 1 then 512 else 1 end) end as headers from pages",
    "destinations": """with l as (select ['GB', 'US', 'HK', 'MO', null, null][c_custkey % 6 + 1] as a, ['GB', 'US', 'HK', null, null][c_custkey % 5 + 1] as b, c_custkey % 6 = 5 and c_custkey % 5 = 4 as silent from customer)
select case when a = b or b is null then a when a is null then b end as code, case when a <> b then 'DISAGREE' when silent then 'NO_LABEL' when a is null and b is null then 'UNRECOGNISED' end as problem, count(*) as targets from l group by all""",
    "claim_fingerprints": r"""select l_orderkey, l_linenumber, l_partkey, sha256('{"extraction_id":"' || l_orderkey || '","extractor":"rule","field_kind":"TUITION","locator":{"block_index":' || l_linenumber || ',"heading_path":["Fees \u2013 \u00a7","' || l_returnflag || '"],"kind":"'
  || case when l_linenumber % 2 = 0 then 'table_cell","row_index":' || l_suppkey else 'block"' end || '},"version":"1.0"}') as fingerprint from lineitem""",
    "body_places": "select case when p_partkey % 7 = 0 then 'NOT_RECORDED' when p_partkey % 6 < 2 then 'CONFIRMED' when p_partkey % 6 < 4 then 'PERIPHERAL' else 'UNCONFIRMED' end as confirmation, count(*) as claims from part group by 1",
    "registered_sources": f"""with p as (select page_id, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) as site from pages), u as (select *, length(site) % 5 as r, site || case length(site) % 5 when 0 then '/f.PDF' when 1 then ':9/' else '/' end as u from p)
select sha256(u) as url_hash, min(page_id) as source_ref, case {_KINDS}[min(page_id) % 17 + 1] when 'UNIVERSITY_HOME' then 'university_site' when 'PROGRAM_CATALOG' then 'university_site' when 'PROGRAM_PAGE' then 'university_site' when 'ACADEMIC_CALENDAR' then 'university_site'
  when 'FACULTY_OR_SCHOOL' then 'faculty_site' when 'TUITION_FEES' then 'fee_page' when 'OFFICIAL_PDF' then 'official_pdf' when 'GOVERNMENT' then 'government_regulator' when 'AUTHORIZED_RANKING' then 'authorized_ranking' when 'NEWS' then 'unclassified'
  else case when min(page_id) % 17 = 16 then 'unclassified' else 'admissions_page' end end as source_type, case when any_value(r) = 0 then 'DOCUMENT' else 'STATIC' end as fetch_strategy, case when any_value(r) = 1 then 'NEEDS_MANUAL_REVIEW' else 'FETCHABLE' end as fetch_eligibility,
  count(*) as claims, not bool_or(page_id % 10 = 3) as is_new from u group by u""",
    "recovered_sources": """with a as (select user_id, event_id, case event_type when 'error' then 'D' when 'signup' then 'E' else case when event_id % 3 = 0 then 'N' else 'C' end end as k, user_id % 4 <> 0 as live from events),
l as (select user_id, arg_max(k, event_id) filter (k in ('D', 'N') or (k = 'E' and live)) as last, coalesce(bool_or(k = 'E' and live), false) as e, coalesce(bool_or(k = 'C'), false) as c, count(*) filter (k = 'E' and not live) as refused from a group by 1)
select s.user_id as source_id, s.user_id % 4 <> 0 as is_active, case last when 'E' then 'FETCHABLE' when 'D' then 'DISABLED' when 'N' then 'NEEDS_MANUAL_REVIEW' else case when s.user_id % 3 = 0 then 'BLOCKED' else 'FETCHABLE' end end as fetch_eligibility,
  case when e or s.user_id % 3 <> 0 then 'OK' else 'BLOCKED' end as access_state, case when s.user_id % 2 = 0 and not coalesce(e or c, false) then date '2024-02-01' end as cooldown_until, coalesce(refused, 0) as refused from (select distinct user_id from events) s left join l on l.user_id = s.user_id""",
    "deadline_contexts": """select o_orderkey, case o_orderkey % 6 when 0 then 'round ' || (o_orderkey % 9) when 1 then 'regular decision' when 2 then 'priority' when 4 then 'restrictive early action' end as round_label,
  case when o_orderkey % 6 in (0, 1, 4) then 'text' when o_orderkey % 6 = 2 then 'heading' end as round_source, case when o_orderkey % 6 = 0 then cast(o_orderkey % 9 as int) end as round_number,
  case o_orderkey % 6 when 0 then '2026/27' when 2 then '2026–27' end as academic_year, case when o_orderkey % 6 = 3 then 2027 end as entry_year from orders""",
    "blocker_matrix": _BLOCKED + " union all ".join([
        _ONE.format("CURRENT", "'all'", ""), _ONE.format("CURRENT_OF_KIND", "cast(kind as varchar)", ""), _ONE.format("READY", "'all'", "where ready"), _ONE.format("READY_OF_KIND", "cast(kind as varchar)", "where ready"),
        *[_ONE.format("BLOCKER", f"'{n}'", f"where {c}") for n, c in {"SUPERSEDED_RULE_VERSION": "b1", "SOURCE_UNVERIFIED": "b3", "SCOPE_UNRESOLVED": "b4", "UNRESOLVED_CONFLICT": "b5", "RESPONSIBILITY_DOES_NOT_AUTHORISE_FIELD": "b6"}.items()],
        _ONE.format("BLOCKER", "'REVIEW_STATE_IS_' || b2", "where b2 is not null")]),
    "scope_vocabulary": """select marker, kind, count(*) as uses, 'order ' || min(o_orderkey) as example from (select o_orderpriority as marker, 'PRIORITY' as kind, o_orderkey from orders where o_orderstatus <> 'P'
  union all select o_orderstatus, 'STATUS', o_orderkey from orders where o_totalprice > 250000) group by marker, kind""",
    "responsibility_counts": "select o_orderpriority as source_type, case when o_orderkey % 3 <> 0 then o_orderkey % 3 end as degree_scope, count(*) as pages, count(*) filter (o_orderstatus = 'P') as pending from orders group by all",
    "responsibility_fanout": "select kinds, count(*) as pages from (select count(distinct o_orderpriority) as kinds from orders group by o_custkey) group by kinds",
}
