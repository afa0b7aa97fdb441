"""Queries over attempts, their consequences and what is recorded of them, from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import eligibility
from claimloom.sources.scratch import scratch
from claimloom.sources.tables import table
from claimloom.streaming import leases, recording

_KINDS = {"signup": "QUEUE", "view": "CLAIM", "click": "HEARTBEAT", "purchase": "FINALIZE"}
_STATUSES = ["OK", "UNCHANGED", "RATE_LIMITED", "DNS_TEMPORARY", "NAME_NOT_RESOLVED", "BLOCKED", "INTERNAL_ERROR", "HTTP_ERROR", "TIMEOUT", "ABANDONED", "RATE_LIMITED"]


def lease_events(spark, d):
    """Events as what workers do with attempts of a source in thirds of a month."""
    e, n = table(spark, d, "events"), F.col("event_id")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("event_type")], F.when(n % 3 == 0, "RELEASE").otherwise("FINALIZE"))
    return e.select(
        F.col("user_id").alias("source_id"), F.concat(F.lit("third "), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string")).alias("cycle"), F.col("ts").alias("at"), "event_id", kind.alias("kind"),
        F.concat(F.lit("worker "), (n % 2).cast("string")).alias("worker"), F.when(n % 5 == 0, (n % 3).cast("int")).alias("generation"), (3600 * (1 + n % 48)).cast("int").alias("seconds"), F.when(n % 2 == 0, "OK").otherwise("TIMEOUT").alias("status"),
    )


def lease_log(spark, d):
    return leases.lease_log(lease_events(spark, d)).withColumn("at", F.unix_millis("at"))


def _outcomes(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), F.date_trunc("millisecond", "ts").alias("at"), (1 + n % 4).cast("int").alias("attempt_no"), F.element_at(F.array(*[F.lit(s) for s in _STATUSES]), (n % 11 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in (404, 500, 410, 503)]), (n % 4 + 1).cast("int")).alias("http_status"), F.when(n % 3 == 0, F.floor(F.col("value") * 20)).alias("retry_after"),
    )


def fetch_reactions(spark, d):
    return leases.reactions(_outcomes(spark, d)).select("run_id", "status", "pause_s", "host_pause_s", "retry_s", "strikes", "judgement")


def _standings(spark, d):
    hosts = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host")).distinct()
    return leases.standings(leases.reactions(_outcomes(spark, d)), hosts)


def source_standings(spark, d):
    return _standings(spark, d)[0].withColumn("cooldown_until", F.unix_millis("cooldown_until"))


def host_pauses(spark, d):
    return _standings(spark, d)[1].withColumn("paused_until", F.unix_millis("paused_until"))


def recorded_fetches(spark, d):
    """All events recorded in three batches, one of them twice, read back: per status the runs, those that name a content, snapshots, contents and bytes."""
    e, n = table(spark, d, "events"), F.col("event_id")
    status = F.when(n % 5 == 0, "TIMEOUT").when(n % 5 == 1, "UNCHANGED").otherwise("OK")
    content = F.encode(F.concat(F.lit("body of "), (F.col("user_id") % 40).cast("string"), F.lit("/"), F.floor(F.col("value") / 50).cast("string")), "utf-8")
    f = e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("at"), status.alias("status"), F.lit(200).alias("http_status"), content.alias("content"))
    recorder = recording.Recorder(spark, scratch(spark, "recorded"))
    for batch in (0, 1, 1, 2):
        recorder.record(f.filter(F.floor((F.dayofmonth("at") - 1) / 10).cast("int") == batch), batch)
    s = recorder.table("snapshots").withColumn("seen", F.lit(1)).join(recorder.table("blobs").select("content_hash", F.col("first_run").alias("run_id"), F.lit(1).alias("first")), ["run_id", "content_hash"], "left")
    runs = recorder.table("runs").join(s.select("run_id", "seen", "first"), "run_id", "left")
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.count("unchanged_content_hash").alias("named"), F.count("seen").alias("snapshots"), F.count("first").alias("contents"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))


def eligibility_after_changes(spark, d):
    """Facts that stay supported when mappings are withdrawn, a domain loses its trust, sources move and evidence comes and goes, kept up to date change by change."""
    n, p, o = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "orders")
    kinds = F.array(*[F.lit(x) for x in ("OFFICIAL", "AUTHORIZED_RANKING", "GOVERNMENT", "TARGET_SCOPE_ONLY")])
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("u"), (F.col("s_suppkey") % 3).cast("string")).alias("url_hash"), F.element_at(kinds, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("eligibility"))
    k = F.col("p_partkey")
    mappings = p.select(
        (k % 100 + 1).alias("source_id"), F.concat(F.lit("u"), ((k % 100 + 1) % 3).cast("string")).alias("url_hash"), F.element_at(kinds, ((k % 100 + 1) % 4 + 1).cast("int")).alias("eligibility"), F.concat(F.lit("d"), (k % 25).cast("string")).alias("domain"), (F.col("p_size") % 10 > 0).alias("is_active"),
    )
    domains = n.select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("domain"), F.when(F.col("n_nationkey") % 6 == 0, "CANDIDATE").otherwise("VERIFIED_OFFICIAL").alias("status"), F.lit(True).alias("domain_active"))
    evidence = o.select((F.col("o_custkey") % 500).alias("fact_id"), (F.col("o_orderkey") % 100 + 1).alias("source_id"), (F.col("o_orderkey") % 3 == 0).alias("is_ranking"))
    e = eligibility.Eligibility(spark, scratch(spark, "eligibility"), {"sources": sources, "mappings": mappings, "domains": domains, "evidence": evidence}, 16)
    signed = lambda rows, w: rows.withColumn("w", F.lit(w).cast("long"))
    gone, late = F.col("source_id") % 4 == 2, F.col("fact_id") % 7 == 0
    e.apply({"mappings": signed(mappings.filter(gone & (F.col("domain") != "d3")), -1), "domains": signed(domains.filter("domain = 'd3'"), -1).unionByName(signed(domains.filter("domain = 'd3'").withColumn("status", F.lit("REJECTED")), 1))})
    e.apply({"evidence": signed(evidence.filter(late), -1), "sources": signed(sources.filter("source_id % 10 = 1"), -1).unionByName(signed(sources.filter("source_id % 10 = 1").withColumn("url_hash", F.lit("elsewhere")), 1))})
    return e.store.table("supported").select("fact_id", "n")


QUERIES = {f.__name__: f for f in (eligibility_after_changes, lease_log, fetch_reactions, source_standings, host_pauses, recorded_fetches)}

_OUT = f"""o as (select user_id as source_id, event_id as run_id, epoch_us(ts) // 1000 as "at", 1 + event_id % 4 as attempt_no, {_STATUSES!r}[event_id % 11 + 1] as status, [404, 500, 410, 503][event_id % 4 + 1] as http_status,
  case when event_id % 3 = 0 then floor(value * 20) end as asked from events),
spells as (select *, count(*) filter (status in ('OK', 'UNCHANGED')) over (partition by source_id order by "at", run_id) as spell, least(300.0, 15 * pow(2, greatest(attempt_no - 1, 0))) as grows from o),
struck as (select *, case when status in ('OK', 'UNCHANGED') then 0 else count(*) filter (status = 'RATE_LIMITED') over (partition by source_id, spell order by "at", run_id) end as strikes,
  case status when 'RATE_LIMITED' then case when asked <> 0 then asked else 900 end when 'DNS_TEMPORARY' then greatest(300, grows) end as pause_s from spells),
r as (select *, case when status = 'RATE_LIMITED' then pause_s end as host_pause_s,
  case when attempt_no >= 3 then null when status = 'RATE_LIMITED' then case when strikes < 4 then pause_s end when status = 'DNS_TEMPORARY' then pause_s
    when status in ('HTTP_ERROR', 'TIMEOUT') and http_status not in (404, 410) then case when asked is null then grows else greatest(1, least(3600, asked)) end end as retry_s,
  case when status = 'NAME_NOT_RESOLVED' or (status = 'RATE_LIMITED' and strikes >= 4) then 'NEEDS_MANUAL_REVIEW' when status = 'BLOCKED' then 'BLOCKED' when status in ('OK', 'UNCHANGED') then 'CLEARED' end as judgement from struck)
"""

ORACLE_SQL = {
    "eligibility_after_changes": """with s as (select s_suppkey as source_id, case when s_suppkey % 10 = 1 then 'elsewhere' else 'u' || (s_suppkey % 3) end as url_hash, ['OFFICIAL', 'AUTHORIZED_RANKING', 'GOVERNMENT', 'TARGET_SCOPE_ONLY'][s_suppkey % 4 + 1] as class from supplier),
m as (select p_partkey % 100 + 1 as source_id, 'u' || ((p_partkey % 100 + 1) % 3) as url_hash, ['OFFICIAL', 'AUTHORIZED_RANKING', 'GOVERNMENT', 'TARGET_SCOPE_ONLY'][(p_partkey % 100 + 1) % 4 + 1] as class, p_partkey % 25 as domain from part where p_size % 10 > 0),
e as (select distinct s.source_id, s.class from s join m using (source_id, url_hash, class) join nation on n_nationkey = domain where n_nationkey % 6 <> 0 and n_nationkey <> 3 and not (source_id % 4 = 2) and s.class <> 'TARGET_SCOPE_ONLY')
select o_custkey % 500 as fact_id, count(*) as n from orders join e on e.source_id = o_orderkey % 100 + 1 where (e.class = 'AUTHORIZED_RANKING') = (o_orderkey % 3 = 0) and o_custkey % 500 % 7 <> 0 group by 1""",
    "lease_log": """with recursive e as materialized (
  select user_id as source_id, 'third ' || cast((day(ts) - 1) // 10 as varchar) as cycle, epoch_us(ts) // 1000 as "at", event_id, 'worker ' || (event_id % 2) as worker, case when event_id % 5 = 0 then event_id % 3 end as generation, 3600 * (1 + event_id % 48) as seconds,
    case event_type when 'signup' then 'QUEUE' when 'view' then 'CLAIM' when 'click' then 'HEARTBEAT' when 'purchase' then 'FINALIZE' else case when event_id % 3 = 0 then 'RELEASE' else 'FINALIZE' end end as kind,
    case when event_id % 2 = 0 then 'OK' else 'TIMEOUT' end as status from events
), n as materialized (select *, row_number() over (partition by source_id, cycle order by "at", event_id) as i from e),
f as (
  select distinct source_id, cycle, 0::bigint as i, 'NONE' as st, 0 as no, 0 as gen, null::varchar as w, 0::bigint as expires, null::bigint as "at", null::bigint as event_id, null::varchar as kind, null::varchar as actor, null::varchar as result, null::varchar as status,
    false as swept, null::varchar as swept_w, 0::bigint as swept_at, 0 as swept_no, 0 as swept_gen from n
  union all
  select source_id, cycle, i,
    case when result <> 'ACCEPTED' then s0 when kind in ('QUEUE', 'RELEASE') then 'QUEUED' when kind in ('CLAIM', 'HEARTBEAT') then 'RUNNING' else 'FINALIZED' end, case when result = 'ACCEPTED' and kind = 'QUEUE' then no + 1 else no end,
    case when result = 'ACCEPTED' and kind = 'CLAIM' then gen + 1 else gen end, case when result <> 'ACCEPTED' or kind = 'HEARTBEAT' then w0 when kind = 'CLAIM' then actor end,
    case when result = 'ACCEPTED' and kind in ('CLAIM', 'HEARTBEAT') then "at" + 1000 * seconds else expires end, "at", event_id, kind, actor, result, status, s0 <> st, w, expires, no, gen
  from (
    select *, case kind when 'QUEUE' then case when s0 in ('QUEUED', 'RUNNING') then 'ALREADY_OPEN' when no >= 3 then 'ATTEMPTS_SPENT' else 'ACCEPTED' end when 'CLAIM' then case when s0 = 'QUEUED' then 'ACCEPTED' else 'NOTHING_QUEUED' end
      else case when s0 = 'RUNNING' and w0 = actor and (generation is null or generation = gen) then 'ACCEPTED' else 'LEASE_LOST' end end as result
    from (
      select f.source_id, f.cycle, n.i, f.st, f.no, f.gen, f.w, f.expires, n."at", n.event_id, n.kind, n.worker as actor, n.generation, n.seconds, n.status,
        case when f.st = 'RUNNING' and f.expires < n."at" then 'ABANDONED' else f.st end as s0, case when f.st = 'RUNNING' and f.expires < n."at" then null else f.w end as w0
      from f join n on n.source_id = f.source_id and n.cycle = f.cycle and n.i = f.i + 1
    )
  )
), done as materialized (select * from f), ends as (select source_id, cycle, max(i) as i from done group by 1, 2)
select source_id, cycle, "at", event_id, kind, actor as worker, no as attempt_no, gen as generation, result, st as state, status from done where i > 0
union all select source_id, cycle, swept_at, null, 'SWEEP', swept_w, swept_no, swept_gen, 'ACCEPTED', 'ABANDONED', 'ABANDONED' from done where swept
union all select source_id, cycle, expires, null, 'SWEEP', w, no, gen, 'ACCEPTED', 'ABANDONED', 'ABANDONED' from done join ends using (source_id, cycle, i) where st = 'RUNNING' and expires < (select max("at") from e)""",
    "fetch_reactions": f"with {_OUT} select run_id, status, pause_s::double as pause_s, host_pause_s::double as host_pause_s, retry_s::double as retry_s, strikes, judgement from r",
    "source_standings": f"""with {_OUT} select source_id,
  max(struct_pack(a := "at", b := run_id, c := case when pause_s is not null then "at" + cast(pause_s * 1000 as bigint) end)) filter (pause_s is not null or judgement = 'CLEARED').c as cooldown_until,
  coalesce(min(struct_pack(a := "at", b := run_id, c := judgement)) filter (judgement in ('BLOCKED', 'NEEDS_MANUAL_REVIEW')).c, 'FETCHABLE') as eligibility, max(struct_pack(a := "at", b := run_id, c := strikes)).c as strikes from r group by source_id""",
    "host_pauses": f"""with {_OUT} select 'h' || (source_id % 20) as host, max("at" + cast(host_pause_s * 1000 as bigint)) as paused_until from r where host_pause_s is not null group by 1""",
    "recorded_fetches": """with f as (select event_id as run_id, user_id as source_id, ts as "at", case event_id % 5 when 0 then 'TIMEOUT' when 1 then 'UNCHANGED' else 'OK' end as status,
  'body of ' || (user_id % 40) || '/' || cast(floor(value / 50) as bigint) as content, (day(ts) - 1) // 10 as batch from events where (day(ts) - 1) // 10 < 3),
g as (select *, case when status = 'OK' then sha256(content) end as h from f),
n as (select *, last_value(h ignore nulls) over (partition by source_id order by "at", run_id rows between unbounded preceding and 1 preceding) as named, row_number() over (partition by h order by batch, "at", run_id) as nth from g)
select status, count(*) as runs, count(*) filter (status = 'UNCHANGED' and named is not null) as named, count(h) as snapshots, count(*) filter (h is not null and nth = 1) as contents, cast(coalesce(sum(case when h is not null then strlen(content) end), 0) as bigint) as bytes from n group by status""",
}
