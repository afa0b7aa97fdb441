"""All relational queries by name over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions.urls import canonical, fold_space
from claimloom.operators import claims, documents, extract, review, runs, web
from claimloom.plans import evidence, intake, leases, pages, reports, routes
from claimloom.sources.tables import append_missing, table
from claimloom.streaming.runs import outcomes_by_window


def _runs(f):
    return lambda spark, d: f(runs.runs_from_events(table(spark, d, "events")))


def _pages(f):
    return lambda spark, d: f(table(spark, d, "pages"))


def _read(f, part):
    """``f`` of ``part`` of the pages, read as documents."""
    return _pages(lambda pages: f(part(documents.documents(pages))))


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"))


def agreement_groups(spark, d):
    g = claims.agreement(_lines(spark, d), ["l_partkey", "l_returnflag"], "v", "l_suppkey")
    return claims.verdict_counts(g)


def corroborated_claims(spark, d):
    return claims.corroborated(_lines(spark, d), ["l_partkey"], "v", "l_suppkey", "l_orderkey").groupBy("n_sources").agg(F.count("*").alias("claims"))


def order_flags(spark, d):
    return claims.flags_by(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


def mapping_reach(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    pairs = claims.either_key(c, s, [("c_custkey", "s_suppkey"), ("c_acctbal", "s_acctbal")], "c_custkey", "s_suppkey")
    return pairs.groupBy("s_suppkey").agg(F.count("*").alias("customers"))


def customers_without_orders(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


def coverage_by_nation(spark, d):
    n, r, c, o = (table(spark, d, t) for t in ("nation", "region", "customer", "orders"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    j = c.join(per, c.c_custkey == per.o_custkey, "left").join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.count("n_orders").alias("with_orders"), F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"), F.round(F.sum("total"), 2).alias("total"))


def gap_classes(spark, d):
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    kind = F.when(F.col("quality").isNull(), "NEVER_LABELLED").when(F.col("quality") == 0, "REJECTED").when(F.col("toxic") == 1, "UNSAFE").when(F.col("n_chars") < 400, "THIN").otherwise("USABLE")
    return docs.join(lab, "doc_id", "left").groupBy(kind.alias("gap")).agg(F.count("*").alias("documents"))


def insert_delta(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return append_missing(table(spark, d, "labels").select("doc_id"), docs, ["doc_id"]).groupBy("source").agg(F.count("*").alias("missing"))


def folded_text(spark, d):
    t = fold_space(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("fingerprint"))


def fingerprint_collisions(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2(fold_space(F.col("text")), 256).alias("fp"))
    return t.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def shape_violations(spark, d):
    l = table(spark, d, "lineitem")
    rules = {"negative": F.col("l_extendedprice") < 0, "discount_range": ~F.col("l_discount").between(0, 0.1), "tax_range": ~F.col("l_tax").between(0, 0.08), "no_quantity": F.coalesce(F.col("l_quantity") <= 0, F.lit(True))}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return l.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def window_counts(spark, d):
    return outcomes_by_window(runs.runs_from_events(table(spark, d, "events")))


def _reviewed(spark, d):
    """Line items as claims: context, conflict, corroboration, band and scope of each."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", (F.col("l_linenumber") % 4).alias("kind"), (F.col("l_partkey") % 25).alias("context"))
    key = ["l_suppkey", "kind", "context"]
    g = l.groupBy(*key).agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.max("l_discount").alias("best"))
    same = l.groupBy(*key, "l_quantity").agg(F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))
    band = lambda c: F.when(c >= 0.07, "HIGH").when(c >= 0.03, "MEDIUM").otherwise("LOW")
    return l.join(g, key).join(same, [*key, "l_quantity"]).select(
        "l_orderkey", "l_linenumber", "kind", band(F.col("l_discount")).alias("band"), (F.col("least") < F.col("most")).alias("in_conflict"), (F.col("first") < F.col("last")).alias("corroborated"),
        (F.col("l_returnflag") == "N").alias("scope_unresolved"), (F.col("best") < 0.03).alias("only"), F.when(F.col("l_returnflag") == "A", "ACCEPTED").otherwise("UNREVIEWED").alias("decision"),
    )


def review_priority(spark, d):
    facts = {"high_risk_field": F.col("kind") < 2, "has_evidence": F.lit(True)} | {c: F.col(c) for c in ("corroborated", "scope_unresolved", "in_conflict")}
    q = review.queue(F.col("band"), F.col("kind") == 3, F.col("decision"), F.col("only"))
    p = review.with_priority(_reviewed(spark, d), "band", facts)
    return p.groupBy(q.alias("queue"), "score", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("claims"))


def publication_blockers(spark, d):
    source = F.when(F.col("l_orderkey") % 3 == 0, "UNVERIFIED").otherwise("OFFICIAL_VERIFIED")
    b = review.blockers(F.col("kind") == 3, F.col("decision"), source, F.col("scope_unresolved"), F.col("in_conflict"), F.col("kind") != 2)
    return _reviewed(spark, d).select("l_orderkey", "l_linenumber", F.array_join(b, ",").alias("blockers")).groupBy("blockers").agg(F.count("*").alias("claims"))


def governing_scope(spark, d):
    return _governing(table(spark, d, "orders"))


def _governing(o):
    j, q = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("J:"), "o_orderstatus")), F.when(F.col("o_totalprice") > 150000, F.lit("Q:1"))
    s = o.select("o_custkey", "o_orderkey", F.array_compact(F.array(j, q)).alias("criteria"), (F.col("o_orderkey") % 3 == 0).alias("human"), review.scope_state(j, q, F.col("o_orderkey") % 5 != 0).alias("state"))
    return review.governing(s, "o_custkey", "o_orderkey", "criteria", "human", "state")


def canonical_urls(spark, d):
    c = canonical(F.col("url"))
    return table(spark, d, "pages").select("page_id", c["rejection"].alias("rejection"), c["canonical"].alias("canonical"), F.sha2(c["canonical"], 256).alias("url_sha256"))


QUERIES = {
    "source_health": _runs(runs.source_health), "outcome_summary": _runs(runs.outcome_summary), "latest_run": _runs(runs.latest_run),
    "outcome_variety": _runs(runs.outcome_variety), "outcome_lists": _runs(runs.outcome_lists), "slowest_runs": _runs(runs.slowest),
    "stratified_sample": _runs(runs.stratified_sample), "cycle_counts": _runs(runs.cycle_counts), "retry_waits": _runs(runs.retry_waits), "window_counts": window_counts,
    "page_hosts": _pages(web.page_hosts), "pages_per_domain": _pages(web.pages_per_domain), "page_shape": _pages(web.page_shape), "block_statistics": _pages(lambda pages: documents.block_statistics(documents.documents(pages))),
    "agreement_groups": agreement_groups, "corroborated_claims": corroborated_claims, "order_flags": order_flags, "mapping_reach": mapping_reach,
    "customers_without_orders": customers_without_orders, "coverage_by_nation": coverage_by_nation, "gap_classes": gap_classes, "insert_delta": insert_delta,
    "folded_text": folded_text, "fingerprint_collisions": fingerprint_collisions, "shape_violations": shape_violations,
    "review_priority": review_priority, "publication_blockers": publication_blockers, "governing_scope": governing_scope, "governing_scope_whole": governing_scope, "canonical_urls": canonical_urls,
    "fee_claims": _read(extract.fees, documents.statements), "english_score_claims": _read(extract.english_scores, documents.statements), "deadline_claims": _read(extract.deadlines, documents.statements),
    "calendar_claims": _read(extract.calendar_dates, documents.statements), "programme_claims": _read(extract.programmes, documents.headings),
}

_R = """with runs as (select user_id as source_id, event_id as run_id, ts as started_at, value as seconds,
  case event_type when 'purchase' then 'OK' when 'view' then 'OK' when 'signup' then 'UNCHANGED' when 'error' then 'HTTP_ERROR' when 'click' then 'BLOCKED' end as outcome from events)
"""
_HEALTH = """, w as (select *, row_number() over x as recency, sum(case when outcome in ('OK','UNCHANGED') then 1 else 0 end) over (partition by source_id order by started_at desc nulls last, run_id desc rows unbounded preceding) as successes
  from runs window x as (partition by source_id order by started_at desc nulls last, run_id desc)),
h as (select source_id, max(outcome) filter (where recency = 1) as last_outcome, count(*) filter (where successes = 0) as failure_streak,
  coalesce(min(recency) filter (where outcome = 'OK'), count(*) + 1) - 1 as since_new_body, max(started_at) filter (where outcome in ('OK','UNCHANGED')) as last_success, count(*) as runs from w group by source_id)
"""
_H = r"lower(split_part(regexp_replace(url, '^[^:]+://([^/?#]*).*$', '\1'), ':', 1))"
_DOMAIN = f"""case when len(string_split({_H}, '.')) < 2 then {_H}
  when regexp_matches({_H}, '\\.(co\\.uk|ac\\.uk|edu\\.cn|com\\.cn|edu\\.hk|edu\\.au)$') and len(string_split({_H}, '.')) >= 3 then array_to_string(string_split({_H}, '.')[-3:], '.')
  else array_to_string(string_split({_H}, '.')[-2:], '.') end"""
_FOLD = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
_REVIEWED = """with c as (select l_orderkey, l_linenumber, l_linenumber % 4 as kind, l_returnflag, case when l_discount >= 0.07 then 'HIGH' when l_discount >= 0.03 then 'MEDIUM' else 'LOW' end as band,
  min(l_quantity) over g < max(l_quantity) over g as in_conflict, max(l_discount) over g < 0.03 as only_weak,
  min(l_orderkey) over (partition by l_suppkey, l_linenumber % 4, l_partkey % 25, l_quantity) < max(l_orderkey) over (partition by l_suppkey, l_linenumber % 4, l_partkey % 25, l_quantity) as corroborated
  from lineitem window g as (partition by l_suppkey, l_linenumber % 4, l_partkey % 25))
"""

ORACLE_SQL = {
    "review_priority": _REVIEWED + """select case when kind = 3 or l_returnflag = 'A' then 'NOT_QUEUED' when band <> 'LOW' then 'PRIMARY' when only_weak then 'ONLY_CANDIDATE' else 'LOW_CONFIDENCE' end as queue,
  cast(5 + case when kind < 2 then 40 else 0 end + case band when 'HIGH' then 25 when 'MEDIUM' then 15 else -20 end + case when corroborated then 20 else 0 end
    - case when l_returnflag = 'N' then 20 else 0 end - case when in_conflict then 15 else 0 end as int) as score,
  concat_ws(',', case when kind < 2 then 'high_risk_field' end, case band when 'HIGH' then 'confidence_high' when 'MEDIUM' then 'confidence_medium' end, case when corroborated then 'corroborated' end, 'has_evidence',
    case when l_returnflag = 'N' then 'scope_unresolved' end, case when in_conflict then 'in_conflict' end, case when band = 'LOW' then 'confidence_low' end) as reasons, count(*) as claims from c group by 1, 2, 3""",
    "publication_blockers": _REVIEWED + """select concat_ws(',', case when kind = 3 then 'SUPERSEDED_RULE_VERSION' end, case when l_returnflag <> 'A' then 'REVIEW_STATE_IS_UNREVIEWED' end, case when l_orderkey % 3 = 0 then 'SOURCE_UNVERIFIED' end,
  case when l_returnflag = 'N' then 'SCOPE_UNRESOLVED' end, case when in_conflict then 'UNRESOLVED_CONFLICT' end, case when kind = 2 then 'RESPONSIBILITY_DOES_NOT_AUTHORISE_FIELD' end) as blockers, count(*) as claims from c group by 1""",
    "governing_scope_whole": """with s as (select o_custkey as k, o_orderkey as id, case when o_orderstatus <> 'P' then o_orderstatus end as j, case when o_totalprice > 150000 then 1 end as q, o_orderkey % 3 = 0 as human from orders),
g as (select k, count(*) as n_scopes, count(distinct j) + count(distinct q) as criteria, max(j is null and q is null and id % 5 = 0) as unscoped from s group by k),
w as (select k, count(*) as n_top, min(id) as one, count(*) filter (human) as n_person, min(id) filter (human) as person from s join g using (k) where (j is not null)::int + (q is not null)::int = criteria group by k)
select k as o_custkey, n_scopes, case when unscoped then null when n_top = 1 then one when n_person = 1 then person end as governing_id from g left join w using (k)""",
    "canonical_urls": r"""with p as (select page_id, trim(url, ' ') as u from pages), q as (select *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1) as netloc from p),
r as (select *, lower(regexp_replace(regexp_replace(netloc, ':[^:\]]*$', ''), '\.$', '')) as host, regexp_extract(netloc, ':([^:\]]*)$', 1) as port from q),
v as (select *, case when u is null or u = '' then 'EMPTY' when length(u) > 2048 then 'TOO_LONG' when regexp_matches(u, '[\s\x00-\x1f\x7f]') then 'FORBIDDEN_CHARACTER' when scheme not in ('http', 'https') then 'SCHEME'
  when contains(netloc, '@') then 'CREDENTIALS' when netloc = '' then 'NO_HOST' when netloc[1] = '[' or regexp_matches(host, '^\d+(\.\d+){3}$') then 'IP_LITERAL'
  when not regexp_matches(host, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$') and host not in ('localhost', 'ip6-localhost', 'metadata') then 'BAD_HOST'
  when regexp_matches(host, '(^|\.)\d+$') then 'NUMERIC_SUFFIX'
  when host in ('localhost', 'ip6-localhost', 'metadata') or regexp_matches(host, '\.(localhost|local|localdomain|internal|intranet|corp|home|lan|test|example|invalid|onion)$') then 'RESERVED_HOST'
  when port not in ('', '80', '443', '8080', '8443') then 'PORT' end as rejection from r),
w as (select *, case when rejection is null then scheme || '://' || host || case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end
  || case when regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) end || case regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) when '?' then '' else regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) end end as canonical from v)
select page_id, rejection, canonical, sha256(canonical) as url_sha256 from w""",
    "source_health": _R + _HEALTH + "select *, case when last_success is null then 'NEVER_SUCCEEDED' when failure_streak >= 3 then 'FAILING' when failure_streak > 0 then 'DEGRADED' else 'HEALTHY' end as state from h",
    "outcome_summary": _R + "select outcome, count(*) as runs, count(distinct source_id) as sources, round(avg(seconds), 4) as mean_s, percentile_disc(0.5) within group (order by seconds) as median_s, min(seconds) as min_s, max(seconds) as max_s from runs group by outcome",
    "latest_run": _R + "select source_id, run_id, outcome, run_count from (select *, count(*) over (partition by source_id) as run_count, row_number() over (partition by source_id order by started_at desc nulls last, run_id desc) as nth from runs) where nth = 1",
    "outcome_variety": _R + "select kinds, count(*) as sources from (select source_id, count(distinct outcome) as kinds from runs group by source_id) group by kinds",
    "outcome_lists": _R + "select source_id, string_agg(distinct outcome, ', ' order by outcome) as outcomes, list_sort(list(seconds))[count(seconds) // 2 + 1] as upper_median_s from runs group by source_id",
    "slowest_runs": _R + "select run_id, source_id, seconds from runs order by seconds desc nulls last, run_id limit 5",
    "stratified_sample": _R + """, quota as (select outcome, greatest(1, cast(round_even(60.0 * count(*) / (select count(*) from runs), 0) as int)) as quota from runs group by outcome),
capped as (select * from (select *, row_number() over (partition by outcome, source_id order by run_id) as nth from runs) join quota using (outcome) where nth <= greatest(2, quota // 6))
select outcome, source_id, run_id from (select *, row_number() over (partition by outcome order by run_id) as place from capped) where place <= quota""",
    "cycle_counts": _R + "select strftime(started_at + interval 8 hour, '%Y-%m-%dT%H') as cycle, count(*) as runs from runs group by 1",
    "retry_waits": _R + _HEALTH + "select source_id, failure_streak, cast(least(300, 15 * pow(2, failure_streak - 1)) as int) as wait_s from h where failure_streak > 0",
    "window_counts": _R + "select date_trunc('hour', started_at) as window_start, outcome, count(*) as runs from runs group by 1, 2",
    "page_hosts": f"select page_id, {_H} as host, split_part(split_part(url, '://', 2), '/', 1) as authority, {_DOMAIN} as domain from pages",
    "pages_per_domain": f"select {_DOMAIN} as domain, count(*) as pages, count(distinct {_H}) as hosts from pages group by 1",
    "page_shape": r"""select page_id, substr(trim(regexp_replace(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), ' '), 1, 300) as title, sha256(h) as body_sha256,
  len(regexp_extract_all(h, '<a ')) as links, len(regexp_extract_all(h, '<p>')) as paragraphs, len(regexp_extract_all(h, '<script')) as scripts,
  case when length(trim(regexp_replace(regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', '', 'g'), ' ')) >= 400 then 'STATIC_HTML' when contains(h, '<script') then 'POSSIBLE_BROWSER' else 'THIN' end as technical_class
  from (select page_id, coalesce(html, '') as h from pages)""",
    "agreement_groups": """select verdict, count(*) as groups, cast(sum(n) as bigint) as claims from (select count(*) as n, case when count(distinct l_quantity) > 1 then 'CONFLICTS' when count(*) = 1 then 'SINGLE' when count(distinct l_suppkey) > 1 then 'AGREES' else 'POSSIBLE_DUPLICATE' end as verdict
  from lineitem where l_partkey is not null and l_returnflag is not null group by l_partkey, l_returnflag) group by verdict""",
    "corroborated_claims": "select n_sources, cast(sum(c) as bigint) as claims from (select count(distinct l_suppkey) as n_sources, count(l_orderkey) as c from lineitem group by l_partkey, l_quantity) where n_sources > 1 group by n_sources",
    "order_flags": "select o_custkey, max(o_orderstatus = 'F') as has_f, max(o_orderstatus = 'O') as has_o, max(o_orderstatus = 'P') as has_p from orders group by o_custkey",
    "mapping_reach": "select s_suppkey, count(*) as customers from (select distinct c_custkey, s_suppkey from customer join supplier on c_custkey = s_suppkey or c_acctbal = s_acctbal) group by s_suppkey",
    "customers_without_orders": "select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "coverage_by_nation": """select r_name, n_name, count(*) as customers, count(n_orders) as with_orders, cast(coalesce(sum(n_orders), 0) as bigint) as orders, round(sum(total), 2) as total
  from customer left join (select o_custkey, count(*) as n_orders, sum(o_totalprice) as total from orders group by o_custkey) on c_custkey = o_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name""",
    "gap_classes": "select case when quality is null then 'NEVER_LABELLED' when quality = 0 then 'REJECTED' when toxic = 1 then 'UNSAFE' when n_chars < 400 then 'THIN' else 'USABLE' end as gap, count(*) as documents from documents left join labels using (doc_id) group by 1",
    "insert_delta": "select source, count(distinct doc_id) as missing from documents where doc_id not in (select doc_id from labels where doc_id is not null) group by source",
    "folded_text": f"select doc_id, length({_FOLD}) as n, sha256({_FOLD}) as fingerprint from documents",
    "fingerprint_collisions": f"select sha256({_FOLD}) as fp, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1",
    "shape_violations": "select rule, count(*) as rows from (select unnest(list_filter([case when l_extendedprice < 0 then 'negative' end, case when not l_discount between 0 and 0.1 then 'discount_range' end, case when not l_tax between 0 and 0.08 then 'tax_range' end, case when coalesce(l_quantity <= 0, true) then 'no_quantity' end], lambda x: x is not null)) as rule from lineitem) group by rule",
}
ORACLE_SQL["governing_scope"] = ORACLE_SQL["governing_scope_whole"]

QUERIES |= evidence.QUERIES | pages.QUERIES | reports.QUERIES | routes.QUERIES | leases.QUERIES | intake.QUERIES
ORACLE_SQL |= evidence.ORACLE_SQL | pages.ORACLE_SQL | reports.ORACLE_SQL | routes.ORACLE_SQL | leases.ORACLE_SQL | intake.ORACLE_SQL
