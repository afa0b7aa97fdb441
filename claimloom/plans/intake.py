"""Queries over workbooks: references of addresses, ids and names of institutions, what hosts say, and percentiles of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import fetches
from claimloom.operators import charsets, context, matching, numbering, percentiles, precedence
from claimloom.sources import manifests
from claimloom.sources.scratch import scratch
from claimloom.sources.tables import table


def official_sources(spark, d):
    """Order lines as cells of a workbook: a reference each, and which of an institution's addresses repeat an earlier one."""
    l = table(spark, d, "lineitem")
    cells = l.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("column"), (F.col("l_suppkey") % 50).alias("institution"), F.when(F.col("l_partkey") % 11 > 0, F.sha2((F.col("l_partkey") % 300).cast("string"), 256)).alias("url_hash"))
    return numbering.official_sources(cells)


def _institution_id(k):
    h = F.md5(k.cast("string"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def id_resolutions(spark, d):
    """Orders as rows with an id in several ways of writing, none, a broken or an unknown one, beside a name that one or several suppliers have."""
    k, s = F.col("s_suppkey"), table(spark, d, "supplier")
    institutions = s.select(_institution_id(k).alias("institution_id"), F.concat(F.lit("University No. "), (k % 70).cast("string")).alias("name"), F.when(k % 5 == 0, F.col("s_name")).alias("other_name"))
    o, n = F.col("o_orderkey"), F.col("o_custkey") % 120 + 1
    i = _institution_id(n)
    raw = F.when(o % 6 == 0, i).when(o % 6 == 1, F.concat(F.lit(" {"), F.upper(i), F.lit("} "))).when(o % 6 == 2, F.replace(i, F.lit("-"), F.lit(""))).when(o % 6 == 3, F.lit(" ")).when(o % 6 == 4, F.lit("12-34"))
    name = F.when(o % 7 < 5, F.concat(F.lit("UNIVERSITY  No. "), (n % 80).cast("string"), F.lit(",")))
    rows = table(spark, d, "orders").select(o.alias("row"), raw.alias("raw_id"), name.alias("raw_name"))
    r = matching.resolutions(rows, institutions)
    return r.select("row", "outcome", "institution_id", F.array_join(F.array_sort("candidates"), ",").alias("candidates"))


def host_evidence(spark, d):
    """What order lines, as pages with hosts and titles, say for their host belonging to an institution."""
    n = F.col("l_suppkey") % 40
    names = F.element_at(F.array(*[F.lit(x) for x in ("University of Harrow", "The Northam College", "Hong Kong Institute of Oakfield", "Ulm")]), (n % 4 + 1).cast("int"))
    host = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("harrow", "oakfield", "www.northam", "ulm", "x")]), (F.col("l_partkey") % 5 + 1).cast("int")), F.lit(".ac.uk"))
    title = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("Welcome to HARROW "), (F.col("l_orderkey") % 4).cast("string"))).when(F.col("l_orderkey") % 3 == 1, "Home")
    pages = table(spark, d, "lineitem").select(F.concat(names, F.lit(" "), n.cast("string")).alias("institution"), host.alias("host"), title.alias("title"))
    e = matching.host_evidence(pages)
    return e.select("institution", "host", "pages", F.array_join("host_tokens", ",").alias("host_tokens"), "titles", "naming_titles")


def price_percentiles(spark, d):
    """The discrete 90th percentile of prices by flag, exactly, with brackets that are narrowed more than once."""
    l = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return percentiles.percentile_disc(l, "l_returnflag", "l_extendedprice", 0.9, accuracy=50, ranked=500)


def decoded_pages(spark, d):
    """Pages encoded in five ways, declared by header, by meta element, wrongly or not at all, decoded to one text."""
    p, n = table(spark, d, "pages"), F.col("page_id")
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "[^ -~\n]", "ä"), "(?i)<meta[^>]*>", "")
    meta = lambda name: F.concat(F.lit(f"<meta charset='{name}'>"), plain)
    text = F.when(n % 6 == 2, meta("latin1")).when(n % 6 == 4, F.concat(meta("none"), F.lit("ä"))).otherwise(F.concat(plain, F.lit("ä")))
    text = F.when(n % 6 == 2, F.concat(text, F.lit("ä"))).otherwise(text)
    latin, utf8 = F.encode(text, "ISO-8859-1"), F.encode(text, "UTF-8")
    payload = F.when(n % 6 == 1, latin).when(n % 6 == 2, latin).when(n % 6 == 3, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(n % 6 == 5, latin).otherwise(utf8)
    header = F.when(n % 6 == 0, "text/html; charset=utf-8").when(n % 6 == 1, "text/html; charset=ISO-8859-1").when(n % 6 == 2, "text/html; charset=utf-8").otherwise("text/html")
    r = charsets.decoded(p.select("page_id", text.alias("meant"), payload.alias("payload"), header.alias("content_type")))
    same = F.regexp_replace("text", "^\ufeff", "") == F.col("meant")
    return r.groupBy((n % 6).alias("way"), "used", "fallback_used", F.array_join("attempts", ", ").alias("attempts"), "lossy", same.alias("same")).agg(F.count("*").alias("pages"))


def scope_precedence(spark, d):
    """Which of two sets of criteria of a context governs, for orders of a customer segment: sets that occur, their claims, and every pair of sets of one context."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    bits = lambda *tests: F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in zip("abcd", tests, strict=True)]))
    criteria = bits(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200_000, F.col("o_custkey") % 3 == 0, k % 5 == 0)
    claims = o.select((F.col("o_custkey") % 40).alias("context"), k.alias("claim_id"), criteria.alias("criteria"), (k % 7 > 0).alias("publishable"), (k % 4 == 0).alias("human"))
    sets = precedence.scope_sets(claims)
    return precedence.verdicts(sets).groupBy("context", "verdict").agg(F.count("*").alias("pairs"), F.sum(F.col("left_claims") * F.col("right_claims")).alias("claim_pairs"))


def manifest_round_trip(spark, d):
    """Orders written under a manifest in two goes and read back, by status: rows, customers, prices, days and whether the manifest has all rows."""
    spark.dataSource.register(manifests.ManifestSource)
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    path = scratch(spark, "manifest")
    o.filter("o_orderstatus = 'F'").write.format("manifest").mode("overwrite").save(path)
    o.filter("o_orderstatus <> 'F'").write.format("manifest").mode("append").save(path)
    back = spark.read.format("manifest").load(path)
    whole = manifests.manifest(path)["rows"] == o.count()
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("day").cast("string").alias("first"), F.lit(whole).alias("whole"))


def retry_waits_asked(spark, d):
    """What Retry-After headers made from orders ask for at the order's day: seconds, dates before and after, dates that no calendar has, words."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    later = F.date_add(F.col("o_orderdate").cast("date"), ((k % 5) - 1).cast("int"))
    day = F.date_format(later, "EEE, dd MMM yyyy")
    value = F.when(k % 6 == 0, (k % 700).cast("string")).when(k % 6 == 1, F.concat(day, F.lit(" 12:30:05 GMT"))).when(k % 6 == 2, F.concat(F.date_format(later, "d-MMM-yy"), F.lit(" 12:30:05 +0200"))).when(k % 6 == 3, "Thu, 31 Feb 2030 00:00:00 GMT").when(k % 6 == 4, " -5 ")
    return o.select(k.alias("o_orderkey"), fetches.retry_after(value, F.col("o_orderdate").cast("date").cast("timestamp")).alias("seconds"))


def challenge_pages(spark, d):
    """Pages behind a challenge: small HTML with a mark; marks in large pages and in other types are none."""
    p, n = table(spark, d, "pages"), F.col("page_id")
    body = F.encode(F.when(n % 4 == 0, "<title>Just a moment...</title>").when(n % 4 == 1, F.concat(F.coalesce("html", F.lit("")), F.lit("cf-browser-verification"), F.repeat(F.lit("x"), 9000))).when(n % 4 == 2, "DDoS protection by X").otherwise(F.coalesce("html", F.lit(""))), "UTF-8")
    kind = F.when(n % 8 == 2, "application/json").when(n % 3 == 0, "Text/HTML; charset=x").otherwise(None)
    return p.groupBy((n % 24).alias("way"), fetches.challenge(body, kind).alias("marker")).agg(F.count("*").alias("pages"))


def _located(spark, d):
    l, k = table(spark, d, "lineitem"), F.col("l_orderkey") + F.col("l_linenumber")
    kinds = [*context.PROGRAM_KINDS, *context.LANGUAGE_KINDS, "TUITION"]
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_orderkey") % 500).alias("extraction_id"), F.col("l_suppkey").alias("institution"), F.concat(F.lit("u"), F.col("l_suppkey").cast("string")).alias("url"),
        F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("l_partkey") % len(kinds) + 1).cast("int")).alias("kind"), F.when(k % 3 == 0, "link").otherwise("block").alias("locator_kind"), F.when(k % 3 > 0, k % 5).alias("block_index"), F.when(k % 4 == 0, k % 2).alias("list_item_index"),
        F.lit(None).cast("long").alias("table_index"), F.lit(None).cast("long").alias("row_index"), F.when(k % 3 == 0, k % 7).alias("link_index"), F.when(k % 2 == 0, "IELTS").when(k % 5 == 0, "TOEFL").alias("test"),
    )


def program_group_shapes(spark, d):
    return context.group_shapes(context.context_groups(_located(spark, d), context.PROGRAM_KINDS, context.program_anchor()))


def language_group_shapes(spark, d):
    return context.group_shapes(context.context_groups(_located(spark, d), context.LANGUAGE_KINDS, context.language_anchor()))


def evidence_integrity(spark, d):
    """How located texts made from order lines relate to the claims' wordings, by kind and in all."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 7 + 1).cast("int"))
    resolved = F.when(k % 7 < 6, pick("13 May", "on 13 May 2027", "13 January 2027 at 6pm", " Apply now ", "Apply", "Something else", ""))
    raw, evidence = pick(" 13 May ", "13 May", "13 January 2027 6pm", "", "zz", "zz", "x"), pick("e", "e", "e", "Apply now", "Apply now please", "Apply now", "x")
    c = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), resolved.alias("resolved"), raw.alias("raw"), evidence.alias("evidence"))
    return context.evidence_integrity(c)


QUERIES = {f.__name__: f for f in (retry_waits_asked, challenge_pages, program_group_shapes, language_group_shapes, evidence_integrity, manifest_round_trip, decoded_pages, scope_precedence, official_sources, id_resolutions, host_evidence, price_percentiles)}

_ID = "substr(md5(cast({0} as varchar)), 1, 8) || '-' || substr(md5(cast({0} as varchar)), 9, 4) || '-' || substr(md5(cast({0} as varchar)), 13, 4) || '-' || substr(md5(cast({0} as varchar)), 17, 4) || '-' || substr(md5(cast({0} as varchar)), 21)"
_KINDS = [*context.PROGRAM_KINDS, *context.LANGUAGE_KINDS, "TUITION"]
_LOCATED = f"""with c as (select l_orderkey % 500 as x, {_KINDS!r}[l_partkey % 11 + 1] as kind, l_orderkey + l_linenumber as k from lineitem),
a as (select *, case when k % 3 = 0 then 'link' else 'block' end || coalesce('/block_index=' || case when k % 3 > 0 then k % 5 end, '') || coalesce('/list_item_index=' || case when k % 4 = 0 then k % 2 end, '') || coalesce('/link_index=' || case when k % 3 = 0 then k % 7 end, '') as program,
  concat_ws('/', coalesce(cast(case when k % 3 > 0 then k % 5 end as varchar), 'none'), coalesce(cast(case when k % 4 = 0 then k % 2 end as varchar), 'none'), case when k % 2 = 0 then 'IELTS' when k % 5 = 0 then 'TOEFL' else 'none' end) as language from c)
"""
_SHAPES = _LOCATED + "select members, kinds, count(*) as groups from (select count(*) as members, string_agg(distinct kind, '+' order by kind) as kinds from a where kind in {kinds} group by x, {anchor}) group by members, kinds"
ORACLE_SQL = {
    "retry_waits_asked": """select o_orderkey, case o_orderkey % 6 when 0 then o_orderkey % 700 when 1 then greatest(0, (o_orderkey % 5 - 1) * 86400 + 45005) when 2 then greatest(0, (o_orderkey % 5 - 1) * 86400 + 37805) when 4 then 0 end::double as seconds from orders""",
    "challenge_pages": """select page_id % 24 as way, case when page_id % 4 = 0 then 'Just a moment...' when page_id % 4 = 2 and page_id % 8 <> 2 then 'DDoS protection by' end as marker, count(*) as pages from pages group by 1, 2""",
    "program_group_shapes": _SHAPES.format(kinds=tuple(context.PROGRAM_KINDS), anchor="program"),
    "language_group_shapes": _SHAPES.format(kinds=tuple(context.LANGUAGE_KINDS), anchor="language"),
    "evidence_integrity": """with r as (select l_returnflag as kind, ['EXACT_RAW', 'CONTAINS_RAW', 'ALL_RAW_TOKENS_PRESENT', 'EQUALS_EVIDENCE', 'WITHIN_EVIDENCE', 'MISMATCH', 'UNRESOLVED'][(l_orderkey + l_linenumber) % 7 + 1] as relation from lineitem)
select kind, false as whole, relation, count(*) as claims from r group by kind, relation union all select null, true, relation, count(*) from r group by relation""",
    "manifest_round_trip": "select o_orderstatus, count(*) as orders, count(distinct o_custkey) as customers, round(sum(o_totalprice), 2) as total, cast(cast(min(o_orderdate) as date) as varchar) as first, true as whole from orders group by o_orderstatus",
    "decoded_pages": """select page_id % 6 as way, ['utf-8', 'iso8859-1', 'iso8859-1', 'utf-16-le', 'utf-8', 'cp1252'][page_id % 6 + 1] as used, page_id % 6 > 3 as fallback_used,
  ['', '', 'http:utf-8 (UnicodeDecodeError)', '', 'document:none (unknown codec)', 'fallback:utf-8 (UnicodeDecodeError)'][page_id % 6 + 1] as attempts, false as lossy, true as same, count(*) as pages from pages group by all""",
    "scope_precedence": """with c as (select o_custkey % 40 as context, (o_orderstatus = 'F')::int + 2 * (o_totalprice > 200000)::int + 4 * (o_custkey % 3 = 0)::int + 8 * (o_orderkey % 5 = 0)::int as bits, o_orderkey % 7 > 0 as pub, o_orderkey % 4 = 0 as human from orders),
g as (select context, bits, pub, human, count(*) as n from c group by all), s as (select *, row_number() over (partition by context order by list_filter([case when bits & 1 > 0 then 'a' end, case when bits & 2 > 0 then 'b' end, case when bits & 4 > 0 then 'c' end, case when bits & 8 > 0 then 'd' end], lambda x: x is not null), pub, human) as k from g),
p as (select l.context, l.n as a, r.n as b, case when not l.pub or not r.pub then 'NOT_PUBLISHABLE' when l.bits = r.bits then case when l.human then 'LEFT_WINS' when r.human then 'RIGHT_WINS' end
  when l.bits & r.bits = l.bits then 'RIGHT_WINS' when l.bits & r.bits = r.bits then 'LEFT_WINS' else 'INCOMPARABLE' end as verdict from s l join s r on l.context = r.context and l.k < r.k
union all select context, n, n - 1, case when pub then 'EQUIVALENT' else 'NOT_PUBLISHABLE' end from s where n > 1)
select context, verdict, count(*) as pairs, cast(sum(a * b) as bigint) as claim_pairs from p group by all""",
    "official_sources": """with c as (select l_orderkey as "row", l_linenumber as "column", l_suppkey % 50 as institution, case when l_partkey % 11 > 0 then sha256(cast(l_partkey % 300 as varchar)) end as url_hash from lineitem),
n as (select *, row_number() over (order by "row", "column", institution, url_hash) as k from c where url_hash is not null), f as (select *, min(k) over (partition by institution, url_hash) as first from n)
select 'S' || case when k < 10000 then lpad(cast(k as varchar), 4, '0') else cast(k as varchar) end as source_ref, "row", "column", institution, url_hash, case when first < k then 'S' || case when first < 10000 then lpad(cast(first as varchar), 4, '0') else cast(first as varchar) end end as duplicate_of from f""",
    "id_resolutions": f"""with i as (select s_suppkey as k, {_ID.format('s_suppkey')} as id, 'university no. ' || (s_suppkey % 70) as key from supplier),
named as (select key, id, row_number() over (partition by key order by id) as nth from i), c as (select key, string_agg(id, ',' order by id) as candidates, count(*) as n from named where nth <= 10 group by key),
r as (select o_orderkey as "row", o_orderkey % 6 as w, o_custkey % 120 + 1 as k, case when o_orderkey % 7 < 5 then 'university no. ' || ((o_custkey % 120 + 1) % 80) end as key from orders),
o as (select r.*, i.id, case when w in (3, 5) then case when coalesce(c.n, 0) > 1 then 'AMBIGUOUS_NAME' else 'MISSING_ID' end when w = 4 then 'MALFORMED_ID' when i.id is null then 'UNKNOWN_ID' else 'RESOLVED' end as outcome, coalesce(c.candidates, '') as candidates
  from r left join i on i.k = r.k left join c on c.key = r.key)
select "row", outcome, case when outcome = 'RESOLVED' then id end as institution_id, case when outcome = 'RESOLVED' then '' else candidates end as candidates from o""",
    "host_evidence": """with p as (select l_suppkey % 40 as n, ['harrow', 'oakfield', 'www.northam', 'ulm', 'x'][l_partkey % 5 + 1] || '.ac.uk' as host, case l_orderkey % 3 when 0 then 'Welcome to HARROW ' || (l_orderkey % 4) when 1 then 'Home' end as title from lineitem),
i as (select *, ['University of Harrow', 'The Northam College', 'Hong Kong Institute of Oakfield', 'Ulm'][n % 4 + 1] || ' ' || n as institution, ['harrow', 'northam', 'oakfield', '-'][n % 4 + 1] as token from p)
select institution, host, count(*) as pages, case when contains(host, any_value(token)) then any_value(token) else '' end as host_tokens, count(distinct title) as titles, count(distinct title) filter (contains(lower(title), token)) as naming_titles from i group by institution, host""",
    "price_percentiles": "select l_returnflag, percentile_disc(0.9) within group (order by l_extendedprice) as l_extendedprice from lineitem group by l_returnflag",
}
