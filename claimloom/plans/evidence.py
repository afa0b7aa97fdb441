"""Queries over sources, registers and claims that are laid over the driver's tables, with SQL that reads each rule its own way.

The views below give the driver's rows the shape of fetch runs, snapshots, sources, targets, mappings,
domains and claims; the SQL states the same views first. "Now" is a literal, as the events are of January 2024.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import values
from claimloom.functions.urls import host, registrable
from claimloom.operators import fleet, grouping, passages, registers
from claimloom.sources.tables import table

def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def runs(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 5
    status = F.when(F.col("event_type") == "error", F.when(k == 1, "TIMEOUT").when(k == 2, "BLOCKED").when(k == 3, "NAME_NOT_RESOLVED").otherwise("HTTP_ERROR")).when(F.col("event_type").isin("view", "click"), "OK").when(F.col("event_type") == "purchase", "UNCHANGED").otherwise("RATE_LIMITED")
    http = F.when(F.col("event_type") == "error", F.when(k == 0, 404).when(k == 2, 403).when(k == 4, 503)).when(F.col("event_type").isin("view", "click"), 200).when(F.col("event_type") == "purchase", 304).otherwise(429)
    return e.select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), status.alias("status"), http.alias("http_status"),
        F.when((F.col("event_type") == "error") & (k == 4), "SSL: CERTIFICATE_VERIFY_FAILED").alias("error_class"),
        F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), _body(F.floor(F.col("value") / 50))).alias("unchanged_content_hash"),
    )


def _body(n):
    return F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("-"), n.cast("string")), 256)


def snapshots(spark, d):
    e = table(spark, d, "events").filter("event_type in ('view', 'click')")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("observed_at"), _body(F.floor(F.col("value") / 50)).alias("content_hash"))


def sources(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("source_id")).distinct()
    s = u.union(u.filter("source_id % 29 = 0").select((F.col("source_id") + 1_000_000).alias("source_id")))
    i = F.col("source_id")
    eligible = F.when(i % 13 == 1, "NEEDS_MANUAL_REVIEW").when(i % 17 == 1, "BLOCKED").when(i % 19 == 1, "DISABLED").otherwise("ELIGIBLE")
    return s.select(
        i, F.concat(F.lit("h"), (i % 40).cast("string")).alias("host"), (i % 11 != 0).alias("is_active"), eligible.alias("fetch_eligibility"), F.when(i % 23 == 1, "BLOCKED").otherwise("OK").alias("access_state"),
        F.when(i % 5 == 0, F.date_add(F.lit("2024-01-30").cast("date"), (i % 3).cast("int")).cast("timestamp")).alias("cooldown_until"),
    )


def host_cooldowns(spark, d):
    h = spark.range(0, 40, 8).select("id")
    return h.select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.date_add(F.lit("2024-01-30").cast("date"), (F.col("id") / 8).cast("int")).cast("timestamp").alias("cooldown_until"))


def attempts(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type").isin("view", "purchase"), "FINALIZED").when((F.col("event_type") == "click") & (F.col("event_id") % 50 == 0), "QUEUED").when((F.col("event_type") == "error") & (F.col("event_id") % 20 == 0), "RUNNING").otherwise("FINALIZED")
    return e.select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("source_id"), (F.col("user_id") % 3 + F.when(F.col("event_id") % 2 == 0, 1).otherwise(0)).alias("attempt_no"), state.alias("state"),
        F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("scheduled_for"), F.timestamp_add("HOUR", (F.col("event_id") % 480).cast("int"), F.col("ts")).alias("lease_expires_at"),
    )


def _status(spark, d):
    return fleet.source_status(sources(spark, d), runs(spark, d), snapshots(spark, d), host_cooldowns(spark, d), as_of(), F.expr("interval 12 hours"))


def source_status(spark, d):
    return _status(spark, d).select("source_id", "total_runs", "last_status", "last_http_status", "last_attempt_at", "last_success_at", "consecutive_failures", "last_content_hash", "health", "schedule_state")


def effective_evidence(spark, d):
    return fleet.effective_evidence(runs(spark, d), snapshots(spark, d))


def access_classes(spark, d):
    s = _status(spark, d)
    kind = fleet.access_class(F.col("last_content_hash").isNotNull() & (F.col("source_id") % 4 == 0), F.col("last_status"), F.col("last_http_status"), F.col("last_error_class"))
    return s.groupBy(kind.alias("access_class")).agg(F.count("*").alias("sources"))


def followups(spark, d):
    s = _status(spark, d)
    return s.groupBy(fleet.followup(F.col("last_status"), F.col("last_http_status"), F.col("last_error_class"), F.col("schedule_state")).alias("bucket")).agg(F.count("*").alias("sources"))


def evidence_gaps(spark, d):
    """Sources without a body, by their last status."""
    s = _status(spark, d).filter((F.col("last_content_hash").isNull()) | (F.col("source_id") % 6 == 0))
    return s.groupBy(F.coalesce("last_status", F.lit("NEVER")).alias("last_status")).agg(F.count("*").alias("sources"), F.count_if(F.col("schedule_state") == "FETCHABLE_NOW").alias("fetchable"))


def rate_limit_strikes(spark, d):
    return fleet.strikes(runs(spark, d))


def expired_leases(spark, d):
    return fleet.expired(attempts(spark, d), as_of())


def retry_attempts(spark, d):
    return fleet.retries(attempts(spark, d), runs(spark, d))


def enqueue_decisions(spark, d):
    return fleet.enqueue_decisions(_status(spark, d), attempts(spark, d)).groupBy("decision").agg(F.count("*").alias("sources"))


def claim_next(spark, d):
    return fleet.claimable(attempts(spark, d), sources(spark, d), host_cooldowns(spark, d), as_of(), 20)


CATEGORIES = ("UNIVERSITY_HOME", "UNDERGRADUATE_ADMISSIONS", "POSTGRADUATE_ADMISSIONS", "PHD_ADMISSIONS", "PROGRAM_CATALOG", "ENTRY_REQUIREMENTS", "LANGUAGE_REQUIREMENTS", "TUITION_FEES", "APPLICATION_DEADLINES", "NEWS")


def _coverage(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    targets = c.select(k.alias("target_id"), F.when(k % 4 != 0, k).alias("university_id"), F.when(k % 10 == 0, "BLOCKED").when(k % 10 == 1, "NEEDS_MANUAL_REVIEW").otherwise("IN_PROGRESS").alias("onboarding_status"))
    i = F.col("o_orderkey")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 10 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "VERIFIED_OFFICIAL").when(F.col("o_orderstatus") == "P", "AUTHORIZED_EXTERNAL").otherwise(F.when(i % 3 == 0, "CANDIDATE").otherwise("VERIFIED_OFFICIAL"))
    mappings = o.select(i.alias("mapping_id"), F.when(i % 2 == 0, F.col("o_custkey")).alias("target_id"), F.when(i % 2 == 1, F.col("o_custkey")).alias("university_id"), category.alias("category"), status.alias("status"), (i % 7 != 0).alias("is_active"))
    scope = F.element_at(F.array(*map(F.lit, ("UNDERGRADUATE", "TAUGHT_POSTGRADUATE", "RESEARCH_POSTGRADUATE"))), (i % 3 + 1).cast("int"))
    return registers.coverage(targets, mappings, o.select(i.alias("mapping_id"), scope.alias("degree_scope")))


def target_coverage(spark, d):
    return _coverage(spark, d).select("target_id", "verified_source_count", "candidate_source_count", *registers.FLAGS, "coverage_status")


def coverage_totals(spark, d):
    c = _coverage(spark, d)
    return c.groupBy("coverage_status").agg(F.count("*").alias("targets"), F.sum("verified_source_count").alias("verified"), *[F.count_if(f).alias(f) for f in registers.FLAGS])


def acquisition_target(spark, d):
    o = table(spark, d, "orders")
    o = o.join(o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")), "o_custkey")
    claims = o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("source_ref"), F.when(F.col("o_orderkey") != F.col("first"), F.col("first")).alias("duplicate_of"))
    t = registers.acquisition_targets(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id")), claims)
    return t.select("source_id", "physical_ref", "first_category", "claim_count", F.array_join("categories", ",").alias("categories"), F.array_join("source_refs", ",").alias("source_refs"))


def _domains(spark, d):
    h = table(spark, d, "pages").select(host(F.col("url")).alias("host")).distinct()
    n = F.length("host")
    exact = h.filter(n % 3 != 0).select("host", F.when(n % 4 == 0, "VERIFIED_OFFICIAL").when(n % 4 == 1, "CANDIDATE").when(n % 4 == 2, "AUTHORIZED_EXTERNAL").otherwise("LEGACY").alias("status"), F.lit(False).alias("covers_subdomains"))
    above = h.select(registrable(F.col("host")).alias("host")).distinct().join(exact.select("host"), "host", "left_anti")
    above = above.select("host", F.when(n % 2 == 0, "VERIFIED_OFFICIAL").otherwise("CANDIDATE").alias("status"), F.lit(True).alias("covers_subdomains"))
    return exact.union(above)


def verification_queue(spark, d):
    hosts = table(spark, d, "pages").select(F.col("page_id").alias("id"), host(F.col("url")).alias("host"))
    q = registers.best_domain(hosts, _domains(spark, d))
    return q.select(F.col("id").alias("page_id"), "host", "domain_host", "domain_status", (F.col("domain_status") == "VERIFIED_OFFICIAL").alias("host_matches_verified_domain"))


def redirect_authority(spark, d):
    h = host(F.col("url"))
    moves = table(spark, d, "pages").select(F.col("page_id").alias("id"), h.alias("requested"), F.when(F.col("page_id") % 2 == 0, registrable(h)).alias("effective"), (F.col("page_id") % 5 != 0).alias("has_evidence"))
    domains = _domains(spark, d).select("host", "status", (F.length("host") % 7 != 0).alias("is_active"), (F.length("host") % 2).alias("institution"))
    return registers.redirect_authority(moves, domains)


def redirect_pairs(spark, d):
    """Hops between hosts: each page's chain of hosts from its own to the registrable one, exploded and counted."""
    h = host(F.col("url"))
    chain = F.array(h, F.when(F.col("page_id") % 2 == 0, registrable(h)).otherwise(h), F.when(F.col("page_id") % 3 == 0, F.lit("login.example")).otherwise(registrable(h)))
    hops = F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.struct(F.element_at(chain, i).alias("from_host"), F.element_at(chain, i + 1).alias("to_host")))
    p = table(spark, d, "pages").select(F.explode(hops).alias("hop")).select("hop.*").filter("from_host <> to_host")
    return p.groupBy("from_host", "to_host").agg(F.count("*").alias("hops"))


def list_changes(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    before = s.filter(k % 10 != 0).select(k, F.floor(F.col("s_acctbal") / 10).alias("rank"), F.floor("s_acctbal").alias("score"), F.col("s_name").alias("name"), F.when(k % 9 != 0, F.col("s_nationkey")).alias("region"))
    after = s.filter(k % 11 != 0).select(k, (F.floor(F.col("s_acctbal") / 10) + F.when(k % 4 == 0, 1).otherwise(0)).alias("rank"), (F.floor("s_acctbal") + F.when(k % 6 == 0, 1).otherwise(0)).alias("score"), F.when(k % 7 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("name"), F.when(k % 8 != 0, F.col("s_nationkey")).alias("region"))
    return registers.list_changes(before, after, "s_suppkey", {"RANK_CHANGED": ["rank"], "SCORE_CHANGED": ["score"], "NAME_CHANGED": ["name"], "REGION_CHANGED": ["region"]})


def duplicate_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower(F.trim("p_type")).alias("name"))
    return p.groupBy("name").agg(F.count("*").alias("rows"), F.min("p_partkey").alias("first_key")).filter("rows > 1")


def queue_counters(spark, d):
    o = table(spark, d, "orders").withColumn("institution", F.col("o_custkey") % 20)
    return registers.counters(o, ["institution", "o_orderpriority", "o_orderstatus"], {"total": F.lit(True), "open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 150000})


def _claims(spark, d):
    """Line items as claims; scope, programme or period may not be stated, kind 3 is never compared."""
    l = table(spark, d, "lineitem")
    scope = F.when(F.col("l_returnflag") == "N", "UNRESOLVED").otherwise(F.col("l_returnflag"))
    programme = F.when(F.col("l_partkey") % 25 == 0, "PROGRAM_UNKNOWN").otherwise((F.col("l_partkey") % 25).cast("string"))
    unit = F.when(F.col("l_orderkey") % 31 != 0, F.col("l_linestatus"))
    return l.select(
        F.col("l_suppkey").alias("institution"), (F.col("l_linenumber") % 4).alias("kind"), scope.alias("scope"), programme.alias("programme"), unit.alias("unit"),
        F.concat(F.lit("amount="), F.col("l_quantity").cast("int").cast("string")).alias("value_key"), F.when(F.col("l_orderkey") % 41 != 0, F.col("l_orderkey") % 3).alias("source"), (F.col("l_linenumber") % 4 != 3).alias("comparable"),
    )


def _keyed(spark, d):
    c = _claims(spark, d)
    key = grouping.context_key({n: F.col(n) for n in ("institution", "kind", "scope", "programme", "unit")}, [F.col("unit")], F.col("comparable"))
    return c.withColumn("key", key)


def agreement_verdicts(spark, d):
    g = grouping.verdicts(_keyed(spark, d), "source")
    return g.groupBy("kind", "verdict").agg(F.count("*").alias("groups"), F.sum("n_claims").alias("claims"), F.sum("n_values").alias("values"))


def unconfirmed_disagreements(spark, d):
    return grouping.unconfirmed(grouping.verdicts(_keyed(spark, d), "source")).groupBy("kind", "n_values").agg(F.count("*").alias("groups"))


def context_conflicts(spark, d):
    c = grouping.context_conflicts(_claims(spark, d).filter("unit is not null"), ["institution", "kind", "value_key"], ["scope", "programme", "unit"])
    return c.groupBy("kind", "differing").agg(F.count("*").alias("conflicts"), F.max("n_contexts").alias("most_contexts"))


def readiness_blockers(spark, d):
    l, k = table(spark, d, "lineitem"), F.col("l_partkey")
    state = lambda n: F.when(n == 0, "CANDIDATE").when(n == 1, "AUTHORIZED_EXTERNAL").when(n < 5, "VERIFIED_OFFICIAL")
    b = registers.readiness_blockers(
        F.col("l_linenumber") == 7, F.when(F.col("l_returnflag") == "A", "ACCEPTED").when(F.col("l_returnflag") == "R", "REJECTED"), state(k % 6), k % 8 != 0, state(k % 7), k % 9 != 0, k % 5 != 0,
        k % 4 != 0, F.when(k % 10 == 0, "NOT_ELIGIBLE").otherwise("ELIGIBLE"), k % 12 == 0, F.col("l_linestatus") == "F")
    e = l.select(F.explode_outer(b).alias("blocker"))
    return e.groupBy(F.coalesce("blocker", F.lit("READY")).alias("blocker")).agg(F.count("*").alias("claims"))


def review_states(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    candidates = c.select(k.alias("candidate_id"), F.concat(F.lit("x"), (k % 6).cast("string")).alias("extractor"), (k % 3).alias("version"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("document_extractor"), (k % 2).alias("artifact_version"))
    rules = spark.range(5).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("extractor"), (F.col("id") % 3).alias("rule_version"))
    documents = spark.range(3).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_extractor"), (F.col("id") % 2).alias("document_version"))
    decision = F.when(F.col("o_orderstatus") == "F", "ACCEPTED").when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("NEEDS_CONTEXT")
    reviews = o.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderdate").alias("decided_at"), F.col("o_orderkey").alias("review_id"), decision.alias("decision"))
    return registers.review_state(candidates, reviews, rules, documents)


def current_claims(spark, d):
    """Candidates that both registers still name, by decision."""
    return review_states(spark, d).filter(~F.col("is_superseded")).groupBy("decision_state").agg(F.count("*").alias("candidates"), F.sum("review_count").alias("reviews"))


def reference_outcomes(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = l.select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 5, 100_000_000).otherwise(0)).alias("ref"), (F.col("l_suppkey") % 3).alias("owner"))
    r = registers.references(rows, o.select(F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 3).alias("owner")), "ref", "owner")
    return r.groupBy("outcome").agg(F.count("*").alias("rows"))


def registry_upsert(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    old = s.filter(k % 3 != 0).select(k, F.when(k % 5 != 0, F.col("s_nationkey")).alias("version"))
    new = s.filter(k % 4 != 0).select(k, (F.col("s_nationkey") + F.when(k % 7 == 0, 1).otherwise(0)).alias("version"))
    return registers.upsert_changed(old, new, "s_suppkey", "version")


def longest_cooldown(spark, d):
    """Host pauses after an upsert that keeps the later end."""
    e = table(spark, d, "events")
    both = e.filter("event_type = 'signup'").select("user_id", "ts").union(e.filter("event_type = 'error'").select("user_id", F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("ts")))
    return both.groupBy(F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")).alias("host")).agg(F.max("ts").alias("cooldown_until"))


def allowed_extractors(spark, d):
    """Per source the union of the extractors that its kinds of event allow; the constant map is one small table."""
    allowed = spark.createDataFrame([("view", ["tuition", "deadline"]), ("click", ["language"]), ("error", []), ("purchase", ["deadline", "program"])], "event_type string, extractors array<string>")
    j = table(spark, d, "events").join(F.broadcast(allowed), "event_type").select("user_id", F.explode_outer("extractors").alias("x"))
    return j.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("extractors"))


def page_grain(spark, d):
    """Pages before their claims are counted: distinct (source, status) first, so that repeated claims don't count twice."""
    p = runs(spark, d).select("source_id", "status").distinct()
    return p.groupBy("status").agg(F.count("*").alias("sources"), F.count_if(F.col("source_id") % 2 == 0).alias("even_sources"))


def orphans(spark, d):
    """Rows that one of two stores has and the other lacks, both directions; some labels name documents that aren't there."""
    docs, k = table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    lab = table(spark, d, "labels").select(F.when(k % 50 == 0, k + 1_000_000_000).otherwise(k).alias("doc_id"))
    one = lambda a, b, kind: a.join(b, "doc_id", "left_anti").select(F.lit(kind).alias("kind"), "doc_id")
    return one(docs, lab, "ORPHAN").union(one(lab, docs, "MISSING_OBJECT")).groupBy("kind").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"))


def audit_subjects(spark, d):
    """Orders whose customer is of a nation, by customer, supplier key or both: ids united, then one semi-join; the nation's name by either side."""
    c, s, o, n = (table(spark, d, t) for t in ("customer", "supplier", "orders", "nation"))
    ids = c.filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")).union(s.filter("s_nationkey = 3").select(F.col("s_suppkey").alias("o_custkey"))).union(c.filter("c_mktsegment = 'BUILDING' and c_nationkey = 4").select(F.col("c_custkey")))
    found = o.join(ids, "o_custkey", "left_semi").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").join(s.select("s_suppkey", "s_nationkey"), F.col("o_custkey") == F.col("s_suppkey"), "left")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("a_name")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("b_name"))
    found = found.join(F.broadcast(a), found.s_nationkey == F.col("a"), "left").join(F.broadcast(b), found.c_nationkey == F.col("b"), "left")
    return found.groupBy(F.coalesce("a_name", "b_name").alias("nation")).agg(F.count("*").alias("orders"))


def partial_dates(spark, d):
    i = F.col("o_orderkey")
    y, m, day = F.when(i % 17 != 0, (2020 + i % 9).cast("int")), F.when(i % 13 != 0, (i % 13).cast("int")), F.when((i % 32 != 0) & (i % 13 != 0), (i % 32).cast("int"))
    r = values.date_range(y, m, day)
    time = F.when(day.isNotNull() & (i % 5 == 0), "12:00")
    return table(spark, d, "orders").select(i, values.precision(y, m, day, F.when(i % 3 == 0, "EARLY"), time).alias("precision"), r["lo"].alias("lo"), r["hi"].alias("hi"))


def list_fingerprints(spark, d):
    parts = [F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")]
    return table(spark, d, "customer").select("c_custkey", values.list_fingerprint(parts).alias("fingerprint"))


def name_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", values.name_key(F.concat(F.lit("  "), F.col("s_name"), F.lit(" ., "))).alias("name_key"))


def address_kinds(spark, d):
    n = F.col("event_id")
    v4 = F.concat_ws(".", *[(n * k % 256).cast("string") for k in (7, 11, 13, 17)])
    address = F.when(n % 5 == 0, F.concat(F.lit("::ffff:"), v4)).when(n % 5 == 1, F.concat(F.lit("10.0.0."), (n % 256).cast("string"))).when(n % 5 == 2, F.lit("169.254.169.254")).when(n % 5 == 3, F.lit("::1")).otherwise(v4)
    return table(spark, d, "events").groupBy(values.address_class(address).alias("kind")).agg(F.count("*").alias("addresses"))


def quoted_passages(spark, d):
    """Benchmark passages of three words or more that documents hold word for word, white space aside."""
    return passages.quoted(table(spark, d, "benchmark"), table(spark, d, "documents"))


QUERIES = {
    f.__name__: f for f in (
        source_status, effective_evidence, access_classes, followups, evidence_gaps, rate_limit_strikes, expired_leases, retry_attempts, enqueue_decisions, claim_next, target_coverage, coverage_totals, acquisition_target,
        verification_queue, redirect_authority, redirect_pairs, list_changes, duplicate_names, queue_counters, agreement_verdicts, unconfirmed_disagreements, context_conflicts, readiness_blockers, review_states, current_claims,
        reference_outcomes, registry_upsert, longest_cooldown, allowed_extractors, page_grain, orphans, audit_subjects, partial_dates, list_fingerprints, name_keys, address_kinds, quoted_passages,
    )
}

_RUNS = """runs as (select user_id as source_id, event_id as run_id, ts as started_at, event_type, event_id, value,
  case when event_type in ('view', 'click') then 'OK' when event_type = 'purchase' then 'UNCHANGED' when event_type = 'signup' then 'RATE_LIMITED' else ['HTTP_ERROR', 'TIMEOUT', 'BLOCKED', 'NAME_NOT_RESOLVED', 'HTTP_ERROR'][event_id % 5 + 1] end as status,
  case when event_type in ('view', 'click') then 200 when event_type = 'purchase' then 304 when event_type = 'signup' then 429 else [404, null, 403, null, 503][event_id % 5 + 1] end as http_status,
  case when event_type = 'error' and event_id % 5 = 4 then 'SSL: CERTIFICATE_VERIFY_FAILED' end as error_class,
  case when event_type = 'purchase' and event_id % 2 = 0 then sha256(user_id || '-' || cast(floor(value / 50) as bigint)) end as named from events),
snaps as (select source_id, run_id as snapshot_id, started_at as observed_at, sha256(source_id || '-' || cast(floor(value / 50) as bigint)) as content_hash from runs where status = 'OK')"""
_SOURCES = """src as (select i as source_id, 'h' || (i % 40) as host, i % 11 <> 0 as is_active, case when i % 13 = 1 then 'NEEDS_MANUAL_REVIEW' when i % 17 = 1 then 'BLOCKED' when i % 19 = 1 then 'DISABLED' else 'ELIGIBLE' end as fetch_eligibility,
  i % 23 = 1 as shut, case when i % 5 = 0 then timestamp '2024-01-30' + interval 1 day * (i % 3) end as cooldown_until from (select distinct user_id as i from events union select distinct user_id + 1000000 from events where user_id % 29 = 0)),
cool as (select 'h' || (8 * n) as host, timestamp '2024-01-30' + interval 1 day * n as host_until from range(0, 5) t(n))"""
_STATUS = f"""with {_RUNS}, {_SOURCES},
seen as (select *, row_number() over w as recency, sum(case when status in ('OK', 'UNCHANGED') then 1 else 0 end) over (w rows unbounded preceding) as good from runs window w as (partition by source_id order by started_at desc nulls last, run_id desc)),
per as (select source_id, count(*) as total_runs, count(*) filter (good = 0) as consecutive_failures, max(started_at) filter (status in ('OK', 'UNCHANGED')) as last_success_at from seen group by source_id),
body as (select distinct on (source_id) source_id, content_hash from snaps order by source_id, observed_at desc, snapshot_id desc),
st as (select src.source_id, coalesce(total_runs, 0) as total_runs, l.status as last_status, l.http_status as last_http_status, l.error_class as last_error_class, l.started_at as last_attempt_at, last_success_at, coalesce(consecutive_failures, 0) as consecutive_failures, content_hash as last_content_hash,
  case when not is_active then 'DISABLED' when fetch_eligibility in ('DISABLED', 'NEEDS_MANUAL_REVIEW', 'BLOCKED') then fetch_eligibility when shut then 'BLOCKED' end as fixed,
  case when l.status is null then 'NEVER_FETCHED' when l.status = 'RATE_LIMITED' or cooldown_until > timestamp '2024-01-31' then 'DEGRADED' when consecutive_failures >= 3 then 'FAILING' when consecutive_failures >= 1 then 'DEGRADED'
    when last_success_at < timestamp '2024-01-30 12:00:00' then 'STALE' else 'HEALTHY' end as h,
  case when cooldown_until > timestamp '2024-01-31' or host_until > timestamp '2024-01-31' then 'COOLDOWN' else 'FETCHABLE_NOW' end as sch
  from src left join per using (source_id) left join (select * from seen where recency = 1) l using (source_id) left join body using (source_id) left join cool using (host)),
state as (select *, coalesce(fixed, h) as health, coalesce(fixed, sch) as schedule_state from st)
"""
_ATTEMPTS = """att as (select event_id as attempt_id, user_id as source_id, user_id % 3 + case when event_id % 2 = 0 then 1 else 0 end as attempt_no,
  case when event_type = 'click' and event_id % 50 = 0 then 'QUEUED' when event_type = 'error' and event_id % 20 = 0 then 'RUNNING' else 'FINALIZED' end as state, case when event_id % 3 <> 0 then ts end as scheduled_for, ts + interval 1 hour * (event_id % 480) as lease_expires_at from events)"""
_CATS = str(list(CATEGORIES))
_COVERAGE = f"""with t as (select c_custkey as target_id, case when c_custkey % 4 <> 0 then c_custkey end as university_id, case c_custkey % 10 when 0 then 'BLOCKED' when 1 then 'NEEDS_MANUAL_REVIEW' else 'IN_PROGRESS' end as onboarding_status from customer),
m as (select t.target_id, o_orderkey as id, {_CATS}[o_orderkey % 10 + 1] as cat, ['UNDERGRADUATE', 'TAUGHT_POSTGRADUATE', 'RESEARCH_POSTGRADUATE'][o_orderkey % 3 + 1] as deg,
  case when o_orderstatus in ('F', 'P') then 1 when o_orderkey % 3 = 0 then 0 else 1 end as ver, o_orderkey % 7 <> 0 as act from t join orders on (o_orderkey % 2 = 0 and o_custkey = target_id) or (o_orderkey % 2 = 1 and o_custkey = university_id)),
v as (select * from m where act and ver = 1),
b as (select t.*, (select count(*) from v where v.target_id = t.target_id) as verified_source_count, (select count(*) from m where m.target_id = t.target_id and ver = 0) as candidate_source_count,
  {", ".join(f"exists (select 1 from v where v.target_id = t.target_id and cat in ({', '.join(repr(k) for k in kinds)}){f' and deg = {scope!r}' if scope else ''}) as {name}" for name, (kinds, scope) in registers.FLAGS.items())} from t),
c as (select *, case when onboarding_status <> 'IN_PROGRESS' then 'BLOCKED' when university_id is null then 'IDENTITY_NOT_VERIFIED' when verified_source_count = 0 then 'NO_SOURCES_MAPPED'
  when {" and ".join(registers.FLAGS)} then 'SOURCE_MAPPING_COMPLETE' else 'SOURCE_MAPPING_INCOMPLETE' end as coverage_status from b)
"""
_H = r"lower(split_part(regexp_replace(url, '^[^:]+://([^/?#]*).*$', '\1'), ':', 1))"
_REG = r"""case when regexp_matches(h, '\.(co\.uk|ac\.uk|edu\.cn|com\.cn|edu\.hk|edu\.au)$') then regexp_extract(h, '([^.]+\.[^.]+\.[^.]+)$', 1) when contains(h, '.') then regexp_extract(h, '([^.]+\.[^.]+)$', 1) else h end"""
_DOMAINS = f"""p as (select page_id, {_H} as h from pages), hs as (select distinct h from p),
ex as (select h as host, ['VERIFIED_OFFICIAL', 'CANDIDATE', 'AUTHORIZED_EXTERNAL', 'LEGACY'][length(h) % 4 + 1] as status, false as covers from hs where length(h) % 3 <> 0),
dom as (select * from ex union all select host, case when length(host) % 2 = 0 then 'VERIFIED_OFFICIAL' else 'CANDIDATE' end, true from (select distinct {_REG} as host from hs) where host not in (select host from ex))"""
_CLAIMS = """with c as (select l_suppkey as institution, l_linenumber % 4 as kind, case when l_returnflag = 'N' then 'UNRESOLVED' else l_returnflag end as scope, case when l_partkey % 25 = 0 then 'PROGRAM_UNKNOWN' else cast(l_partkey % 25 as varchar) end as programme,
  case when l_orderkey % 31 <> 0 then l_linestatus end as unit, cast(l_quantity as int) as q, coalesce(cast(case when l_orderkey % 41 <> 0 then l_orderkey % 3 end as varchar), '?') as source from lineitem)"""
_GROUPS = _CLAIMS + """, g as (select kind, scope = 'UNRESOLVED' or programme = 'PROGRAM_UNKNOWN' as thin, count(*) as n, count(distinct q) as vals, count(distinct source) as srcs from c where kind <> 3 and unit is not null group by kind, institution, scope, programme, unit),
v as (select kind, n, vals, case when vals > 1 and thin then 'INSUFFICIENT_CONTEXT' when vals > 1 then 'CONFLICTS' when n = 1 then 'SINGLE' when srcs > 1 then 'AGREES' else 'POSSIBLE_DUPLICATE' end as verdict from g
  union all select kind, 1, 1, case when kind = 3 then 'NOT_COMPARABLE' else 'INSUFFICIENT_CONTEXT' end from c where kind = 3 or unit is null)"""
_REVIEWS = """with r as (select o_custkey, count(*) as n, arg_max(case o_orderstatus when 'F' then 'ACCEPTED' when 'O' then 'REJECTED' else 'NEEDS_CONTEXT' end, (o_orderdate, o_orderkey)) as decision from orders group by o_custkey),
s as (select c_custkey as candidate_id, not (c_custkey % 6 < 5 and c_custkey % 6 % 3 = c_custkey % 3) as rule_superseded, not (c_custkey % 4 < 3 and c_custkey % 4 % 2 = c_custkey % 2) as document_superseded, n, decision from customer left join r on o_custkey = c_custkey),
states as (select candidate_id, rule_superseded, document_superseded, rule_superseded or document_superseded as is_superseded, n is not null and (rule_superseded or document_superseded) as review_superseded, coalesce(decision, 'UNREVIEWED') as decision_state, coalesce(n, 0) as review_count from s)
"""
_FOLD = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"

ORACLE_SQL = {
    "source_status": _STATUS + "select source_id, total_runs, last_status, last_http_status, last_attempt_at, last_success_at, consecutive_failures, last_content_hash, health, schedule_state from state",
    "effective_evidence": f"""with {_RUNS}, ok as (select *, row_number() over (partition by source_id order by started_at desc nulls last, run_id desc) as recency from runs where status in ('OK', 'UNCHANGED')),
l as (select * from ok where recency = 1), f as (select source_id, min(recency) as first_ok from ok where status = 'OK' group by source_id),
n as (select ok.source_id, count(*) as unchanged_runs from ok left join f using (source_id) where status = 'UNCHANGED' and recency < coalesce(first_ok, 2147483647) group by ok.source_id),
b as (select distinct on (l.source_id) l.source_id, snapshot_id, content_hash, observed_at from l join snaps s on s.source_id = l.source_id and (l.named is null or s.content_hash = l.named) order by l.source_id, observed_at desc, snapshot_id desc)
select l.source_id, snapshot_id, content_hash, observed_at, l.status as latest_status, l.started_at as confirmed_at, coalesce(unchanged_runs, 0) as unchanged_runs from l left join b using (source_id) left join n using (source_id)""",
    "access_classes": _STATUS + """select case when last_content_hash is not null and source_id % 4 = 0 then 'BODY_EVIDENCE' when last_status = 'BLOCKED' then 'BLOCKED' when last_status = 'NAME_NOT_RESOLVED' then 'DEAD_HOST' when last_status = 'TIMEOUT' then 'TIMEOUT' when last_status is null then 'NO_ATTEMPT'
  when last_http_status in (404, 410) then 'DEAD_NOT_FOUND' when last_error_class is not null then 'TLS_FAILURE' else 'OTHER_HTTP' end as access_class, count(*) as sources from state group by 1""",
    "followups": _STATUS + """select case when last_status is null then 'NOT_YET_ATTEMPTED' when last_http_status = 404 then 'DEAD_URL' when last_status = 'BLOCKED' then 'BLOCKED_ACCESS' when schedule_state = 'COOLDOWN' or last_status = 'RATE_LIMITED' then 'RETRY_AFTER_COOLDOWN'
  when last_error_class like '%CERTIFICATE_VERIFY_FAILED%' then 'TLS_CHAIN_FAILURE' when last_status = 'NAME_NOT_RESOLVED' then 'NAME_NOT_RESOLVED' when last_status = 'TIMEOUT' then 'TEMPORARY_NETWORK_FAILURE' when last_http_status is not null then 'UNEXPECTED_HTTP_STATUS' else 'SOURCE_REVIEW_OTHER' end as bucket, count(*) as sources from state group by 1""",
    "evidence_gaps": _STATUS + "select coalesce(last_status, 'NEVER') as last_status, count(*) as sources, count(*) filter (schedule_state = 'FETCHABLE_NOW') as fetchable from state where last_content_hash is null or source_id % 6 = 0 group by 1",
    "rate_limit_strikes": _STATUS + "select source_id, cast(least(4, count(*) filter (status = 'RATE_LIMITED')) as int) as strikes, count(*) filter (status = 'RATE_LIMITED') >= 4 as host_paused from seen where good = 0 group by source_id",
    "expired_leases": f"with {_ATTEMPTS} select attempt_id, source_id, attempt_no, 'ABANDONED' as status, lease_expires_at as finished_at from att where state = 'RUNNING' and lease_expires_at < timestamp '2024-01-31'",
    "retry_attempts": _STATUS.rstrip() + f""", {_ATTEMPTS}, a as (select source_id, max(attempt_no) as n from att group by source_id having count(*) filter (state <> 'FINALIZED') = 0)
select source_id, n + 1 as attempt_no, status from a join (select source_id, status from seen where recency = 1) using (source_id) where n < 3 and status in ('TIMEOUT', 'RATE_LIMITED', 'HTTP_ERROR')""",
    "enqueue_decisions": _STATUS.rstrip() + f""", {_ATTEMPTS} select case when schedule_state = 'COOLDOWN' then 'COOLDOWN' when schedule_state <> 'FETCHABLE_NOW' then 'NOT_FETCHABLE' when source_id in (select source_id from att where state <> 'FINALIZED') then 'ALREADY_QUEUED' else 'ENQUEUED' end as decision, count(*) as sources from state group by 1""",
    "claim_next": f"with {_ATTEMPTS}, {_SOURCES} select attempt_id, source_id, host, scheduled_for from att join src using (source_id) where state = 'QUEUED' and host not in (select host from cool where host_until > timestamp '2024-01-31') order by scheduled_for nulls first, attempt_id limit 20",
    "target_coverage": _COVERAGE + f"select target_id, verified_source_count, candidate_source_count, {', '.join(registers.FLAGS)}, coverage_status from c",
    "coverage_totals": _COVERAGE + f"select coverage_status, count(*) as targets, cast(sum(verified_source_count) as bigint) as verified, {', '.join(f'count(*) filter ({f}) as {f}' for f in registers.FLAGS)} from c group by 1",
    "acquisition_target": "select o_custkey as source_id, min(o_orderkey) as physical_ref, arg_min(o_orderpriority, o_orderkey) as first_category, count(*) as claim_count, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as categories, string_agg(o_orderkey, ',' order by o_orderkey) as source_refs from orders join customer on c_custkey = o_custkey group by o_custkey",
    "verification_queue": f"""with {_DOMAINS}, q as (select page_id, h, host, status, row_number() over (partition by page_id order by case status when 'VERIFIED_OFFICIAL' then 0 when 'AUTHORIZED_EXTERNAL' then 1 when 'CANDIDATE' then 2 else 3 end, length(host) desc) as nth
  from p left join dom on host = h or (covers and right(h, length(host) + 1) = '.' || host)) select page_id, h as host, host as domain_host, status as domain_status, status = 'VERIFIED_OFFICIAL' as host_matches_verified_domain from q where nth = 1""",
    "redirect_authority": f"""with {_DOMAINS}, a as (select host, status in ('VERIFIED_OFFICIAL', 'AUTHORIZED_EXTERNAL') and length(host) % 7 <> 0 as ok, length(host) % 2 as inst from dom),
m as (select page_id as id, h as requested, case when page_id % 2 = 0 then {_REG} else h end as effective from p)
select id, requested, effective, case when id % 5 = 0 then 'NO_EVIDENCE' when r.ok is not true then 'REQUESTED_UNTRUSTED' when effective <> requested and e.ok is not true then 'EFFECTIVE_UNTRUSTED' when effective <> requested and r.inst is distinct from e.inst then 'INSTITUTION_MISMATCH' else 'OK' end as verdict
from m left join a r on r.host = requested left join a e on e.host = effective""",
    "redirect_pairs": f"""with p as (select page_id, {_H} as h from pages), r as (select page_id, h as a, case when page_id % 2 = 0 then {_REG} else h end as b, case when page_id % 3 = 0 then 'login.example' else {_REG} end as c from p),
x as (select a as from_host, b as to_host from r union all select b, c from r) select from_host, to_host, count(*) as hops from x where from_host <> to_host group by 1, 2""",
    "list_changes": """with x as (select s_suppkey as k, cast(floor(s_acctbal / 10) as bigint) as rank, cast(floor(s_acctbal) as bigint) as score, s_name as name, case when s_suppkey % 9 <> 0 then s_nationkey end as region,
  cast(floor(s_acctbal / 10) as bigint) + (s_suppkey % 4 = 0)::int as rank2, cast(floor(s_acctbal) as bigint) + (s_suppkey % 6 = 0)::int as score2, case when s_suppkey % 7 = 0 then upper(s_name) else s_name end as name2, case when s_suppkey % 8 <> 0 then s_nationkey end as region2 from supplier),
b as (select *, concat_ws('|', rank, score, name, coalesce(region::varchar, '-')) as was, concat_ws('|', rank2, score2, name2, coalesce(region2::varchar, '-')) as now from x)
select k as s_suppkey, 'ADDED_TARGET' as change_kind, null as before_value, now as after_value from b where k % 10 = 0 and k % 11 <> 0 union all select k, 'REMOVED_FROM_NEW_LIST', was, null from b where k % 10 <> 0 and k % 11 = 0
union all select k, 'RANK_CHANGED', rank::varchar, rank2::varchar from b where k % 10 <> 0 and k % 11 <> 0 and rank <> rank2 union all select k, 'SCORE_CHANGED', score::varchar, score2::varchar from b where k % 10 <> 0 and k % 11 <> 0 and score <> score2
union all select k, 'NAME_CHANGED', name, name2 from b where k % 10 <> 0 and k % 11 <> 0 and name <> name2 union all select k, 'REGION_CHANGED', coalesce(region::varchar, '-'), coalesce(region2::varchar, '-') from b where k % 10 <> 0 and k % 11 <> 0 and region is distinct from region2""",
    "duplicate_names": "select lower(trim(p_type)) as name, count(*) as rows, min(p_partkey) as first_key from part group by 1 having count(*) > 1",
    "queue_counters": " union all ".join(f"select '{n}' as dimension, cast({c} as varchar) as key, count(*) as total, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_totalprice > 150000) as large from orders group by 2" for n, c in (("institution", "o_custkey % 20"), ("o_orderpriority", "o_orderpriority"), ("o_orderstatus", "o_orderstatus"))),
    "agreement_verdicts": _GROUPS + " select kind, verdict, count(*) as groups, cast(sum(n) as bigint) as claims, cast(sum(vals) as bigint) as values from v group by 1, 2",
    "unconfirmed_disagreements": _GROUPS + " select kind, vals as n_values, count(*) as groups from v where verdict = 'INSUFFICIENT_CONTEXT' and vals > 1 group by 1, 2",
    "context_conflicts": _CLAIMS + """, g as (select kind, count(distinct (scope, programme, unit)) as n, count(distinct scope) > 1 as ds, count(distinct programme) > 1 as dp, count(distinct unit) > 1 as du, bool_or(scope = 'UNRESOLVED') as us, bool_or(programme = 'PROGRAM_UNKNOWN') as up
  from c where unit is not null group by institution, kind, q) select kind, concat_ws(',', case when ds then 'scope' end, case when dp then 'programme' end, case when du then 'unit' end) as differing, count(*) as conflicts, max(n) as most_contexts from g where n > 1 and not (ds and us) and not (dp and up) group by 1, 2""",
    "readiness_blockers": """with x as (select l_linenumber = 7 as old, l_returnflag as f, l_partkey as k, l_linestatus as s from lineitem), b as (select list_filter([case when old then 'NOT_CURRENT' end, case when f <> 'A' then 'NOT_ACCEPTED' end, case when k % 6 in (0, 5) or k % 8 = 0 then 'DOMAIN_NOT_VERIFIED' end,
  case when k % 7 in (0, 5, 6) or k % 9 = 0 then 'RESPONSIBILITY_NOT_VERIFIED' when k % 5 = 0 then 'MAPPING_NOT_PROMOTED' end, case when k % 4 = 0 then 'RESPONSIBILITY_INCOMPATIBLE' end, case when k % 10 = 0 then 'SOURCE_NOT_ELIGIBLE' end, case when k % 12 = 0 then 'SOURCE_SUPERSEDED' end, case when s = 'F' then 'SCOPE_UNRESOLVED' end], lambda i: i is not null) as l from x)
select blocker, count(*) as claims from (select unnest(case when len(l) = 0 then ['READY'] else l end) as blocker from b) group by 1""",
    "review_states": _REVIEWS + "select * from states",
    "current_claims": _REVIEWS + "select decision_state, count(*) as candidates, cast(sum(review_count) as bigint) as reviews from states where not is_superseded group by 1",
    "reference_outcomes": "select case when o_orderkey is null then 'UNDEFINED' when o_custkey % 3 <> l_suppkey % 3 then 'WRONG_OWNER' else 'OK' end as outcome, count(*) as rows from lineitem left join orders on o_orderkey = l_orderkey and l_linenumber <> 5 group by 1",
    "registry_upsert": """select s_suppkey, case when s_suppkey % 4 <> 0 then s_nationkey + (s_suppkey % 7 = 0)::int when s_suppkey % 5 <> 0 then s_nationkey end as version,
  case when s_suppkey % 3 = 0 then 'INSERTED' when s_suppkey % 4 <> 0 and (s_suppkey % 5 = 0 or s_suppkey % 7 = 0) then 'UPDATED' else 'KEPT' end as action from supplier where s_suppkey % 3 <> 0 or s_suppkey % 4 <> 0""",
    "longest_cooldown": "select 'h' || (user_id % 40) as host, max(case when event_type = 'error' then ts + interval 1 hour else ts end) as cooldown_until from events where event_type in ('error', 'signup') group by 1",
    "allowed_extractors": """select user_id, concat_ws(',', case when max(event_type in ('view', 'purchase')) then 'deadline' end, case when max(event_type = 'click') then 'language' end, case when max(event_type = 'purchase') then 'program' end, case when max(event_type = 'view') then 'tuition' end) as extractors
  from events where event_type <> 'signup' group by user_id""",
    "page_grain": f"with {_RUNS} select status, count(distinct source_id) as sources, count(distinct source_id) filter (source_id % 2 = 0) as even_sources from runs group by 1",
    "orphans": """with l as (select case when doc_id % 50 = 0 then doc_id + 1000000000 else doc_id end as doc_id from labels)
select 'ORPHAN' as kind, count(*) as rows, min(doc_id) as first_id from documents where doc_id not in (select doc_id from l) having count(*) > 0 union all select 'MISSING_OBJECT', count(*), min(doc_id) from l where doc_id not in (select doc_id from documents) having count(*) > 0""",
    "audit_subjects": """select coalesce(a.n_name, b.n_name) as nation, count(*) as orders from orders left join customer on c_custkey = o_custkey left join supplier on s_suppkey = o_custkey left join nation a on a.n_nationkey = s_nationkey left join nation b on b.n_nationkey = c_nationkey
  where o_custkey in (select c_custkey from customer where c_nationkey = 3) or o_custkey in (select s_suppkey from supplier where s_nationkey = 3) or o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 4) group by 1""",
    "partial_dates": """with p as (select o_orderkey as i, case when o_orderkey % 17 <> 0 then 2020 + o_orderkey % 9 end as y, case when o_orderkey % 13 <> 0 then o_orderkey % 13 end as m, case when o_orderkey % 32 <> 0 and o_orderkey % 13 <> 0 then o_orderkey % 32 end as d from orders),
x as (select *, make_date(y, coalesce(m, 1), 1) as f, try_cast(y || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') as date) as e from p)
select i as o_orderkey, case when y is null then null when d is not null and i % 5 = 0 then 'DATETIME' when d is not null then 'DATE' when i % 3 = 0 then 'MONTH_PART' when m is not null then 'MONTH' else 'YEAR' end as precision,
  case when d is not null then e else f end as lo, cast(case when d is not null then e + 1 when m is not null then f + interval 1 month else f + interval 1 year end as date) as hi from x""",
    "list_fingerprints": """select c_custkey, sha256('["' || c_name || '", "' || c_mktsegment || '", "' || c_nationkey || '"]') as fingerprint from customer""",
    "name_keys": "select s_suppkey, lower(s_name) as name_key from supplier",
    "quoted_passages": f"select item_id, count(*) as documents, min(doc_id) as first_doc from (select item_id, {_FOLD} as quote from benchmark) b join (select doc_id, {_FOLD} as body from documents) d on contains(body, quote) where quote <> '' group by 1",
}
