"""Registers of targets, domains and claims: coverage, matching hosts, list changes, authority, readiness and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verification states that make a page or domain trusted, and the order of states when several domains match.
TRUSTED = ("VERIFIED_OFFICIAL", "AUTHORIZED_EXTERNAL")
STATE_ORDER = (*TRUSTED, "CANDIDATE", "LEGACY")
#: Flags of coverage with the categories that meet them and the degree scope that these need.
FLAGS = {
    "has_homepage": (("UNIVERSITY_HOME",), None), "has_undergraduate_admissions": (("UNDERGRADUATE_ADMISSIONS",), "UNDERGRADUATE"),
    "has_taught_postgraduate_admissions": (("POSTGRADUATE_ADMISSIONS",), "TAUGHT_POSTGRADUATE"), "has_research_postgraduate_admissions": (("PHD_ADMISSIONS", "POSTGRADUATE_ADMISSIONS"), "RESEARCH_POSTGRADUATE"),
    "has_program_catalog": (("PROGRAM_CATALOG", "PROGRAM_PAGE"), None), "has_entry_requirements": (("ENTRY_REQUIREMENTS",), None), "has_language_requirements": (("LANGUAGE_REQUIREMENTS",), None),
    "has_tuition": (("TUITION_FEES",), None), "has_deadlines": (("APPLICATION_DEADLINES", "ACADEMIC_CALENDAR"), None),
}


def reach(targets: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings of each target, by its own id or by the university it was matched to: one equi-join each, united."""
    t = targets.select("target_id", "university_id")
    own = mappings.join(t.select("target_id"), "target_id").select("target_id", "mapping_id", "category", "status", "is_active")
    through = mappings.drop("target_id").join(t.filter("university_id is not null"), "university_id").select("target_id", "mapping_id", "category", "status", "is_active")
    return own.union(through).distinct()


def coverage(targets: DataFrame, mappings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Per target: the nine flags, counts of trusted and candidate sources, and the first status that fits. All flags come from one aggregate."""
    m = reach(targets, mappings).withColumn("trusted", F.col("is_active") & F.col("status").isin(*TRUSTED))
    s = scopes.groupBy("mapping_id").agg(F.collect_set("degree_scope").alias("scopes"))
    m = m.join(s, "mapping_id", "left")
    holds = {
        name: F.coalesce(F.max(F.col("trusted") & F.col("category").isin(*kinds) & (F.coalesce(F.array_contains("scopes", scope), F.lit(False)) if scope else F.lit(True))), F.lit(False))
        for name, (kinds, scope) in FLAGS.items()
    }
    per = m.groupBy("target_id").agg(F.count_if("trusted").alias("verified_source_count"), F.count_if(F.col("status") == "CANDIDATE").alias("candidate_source_count"), *[c.alias(n) for n, c in holds.items()])
    j = targets.join(per, "target_id", "left").fillna(0, ["verified_source_count", "candidate_source_count"]).fillna(False, list(FLAGS))
    whole = F.lit(True)
    for name in FLAGS:
        whole = whole & F.col(name)
    status = (
        F.when(F.col("onboarding_status").isin("BLOCKED", "NEEDS_MANUAL_REVIEW"), "BLOCKED").when(F.col("university_id").isNull(), "IDENTITY_NOT_VERIFIED").when(F.col("verified_source_count") == 0, "NO_SOURCES_MAPPED")
        .when(whole, "SOURCE_MAPPING_COMPLETE").otherwise("SOURCE_MAPPING_INCOMPLETE")
    )
    return j.withColumn("coverage_status", status)


def acquisition_targets(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Each source with a physical claim (no duplicate of another) beside the least of these, and the number, categories and references of all its claims."""
    per = claims.groupBy("source_id").agg(F.count("*").alias("claim_count"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_list("source_ref")).alias("source_refs"))
    physical = claims.filter("duplicate_of is null").groupBy("source_id").agg(F.min(F.struct("source_ref", "category")).alias("p"))
    physical = physical.select("source_id", F.col("p.source_ref").alias("physical_ref"), F.col("p.category").alias("first_category"))
    return sources.join(physical, "source_id").join(per, "source_id", "left")


#: Domains of a single label that may be broadcast.
BROADCAST_LABELS = 10_000


def best_domain(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Each row of ``hosts`` (id, host) beside the domain that equals its host, or covers it from above: the best status, then the longest host.

    Different hosts are exploded to their suffixes, so an equi-join finds what a suffix comparison of all pairs would. The last label, which many hosts share, is looked up apart, among
    the few domains of one label, so hosts don't meet on it.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rank = F.array_position(F.array(*map(F.lit, STATE_ORDER)), F.col("d.status"))
    at = hosts.filter("host is not null").select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    d = domains.select(F.col("host").alias("suffix"), F.struct(F.col("status"), F.col("covers_subdomains")).alias("d"))
    short = d.filter(~F.contains("suffix", F.lit(".")))
    if short.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        dotted = F.contains("suffix", F.lit("."))
        found = at.filter(dotted).join(d.filter(dotted), "suffix").unionByName(at.filter(~dotted).join(F.broadcast(short), "suffix"))
    else:
        found = at.join(d, "suffix")
    found = found.filter((F.col("suffix") == F.col("host")) | F.col("d.covers_subdomains"))
    order = F.struct(F.when(rank > 0, rank).otherwise(99).alias("rank"), (-F.length("suffix")).alias("len"), F.col("suffix"), F.col("d.status").alias("status"))
    best = found.groupBy("host").agg(F.min(order).alias("b")).select("host", F.col("b.suffix").alias("domain_host"), F.col("b.status").alias("domain_status"))
    return hosts.join(best, "host", "left").select(*hosts.columns, "domain_host", "domain_status")


def redirect_authority(moves: DataFrame, domains: DataFrame) -> DataFrame:
    """Verdict on each row of ``moves`` (id, requested, effective, has_evidence): may the host that answered speak for the one asked?"""
    d = domains.select("host", (F.col("is_active") & F.col("status").isin(*TRUSTED)).alias("trusted"), "institution")
    side = lambda name: d.select(F.col("host").alias(name), F.col("trusted").alias(f"{name}_trusted"), F.col("institution").alias(f"{name}_institution"))
    m = moves.withColumn("effective", F.coalesce("effective", "requested")).join(side("requested"), "requested", "left").join(side("effective"), "effective", "left")
    moved = F.col("effective") != F.col("requested")
    verdict = (
        F.when(~F.col("has_evidence"), "NO_EVIDENCE").when(~F.coalesce("requested_trusted", F.lit(False)), "REQUESTED_UNTRUSTED").when(moved & ~F.coalesce("effective_trusted", F.lit(False)), "EFFECTIVE_UNTRUSTED")
        .when(moved & ~F.col("requested_institution").eqNullSafe(F.col("effective_institution")), "INSTITUTION_MISMATCH").otherwise("OK")
    )
    return m.select("id", "requested", "effective", verdict.alias("verdict"))


def list_changes(before: DataFrame, after: DataFrame, key: str, fields: dict[str, list[str]]) -> DataFrame:
    """Changes between two lists, one row each: ADDED_TARGET, REMOVED_FROM_NEW_LIST, or a kind of ``fields`` whose columns differ (null-safe)."""
    cols = [c for c in before.columns if c != key]
    both = before.select(key, F.struct(*cols).alias("b")).join(after.select(key, F.struct(*cols).alias("a")), key, "full")
    differ = lambda names: F.expr(" or ".join(f"not (b.{n} <=> a.{n})" for n in names))
    kept = F.col("b").isNotNull() & F.col("a").isNotNull()
    text = lambda side, names: F.concat_ws("|", *[F.coalesce(F.col(f"{side}.{n}").cast("string"), F.lit("-")) for n in names])
    row = lambda kind, names, b, a: F.struct(F.lit(kind).alias("change_kind"), (text("b", names) if b else F.lit(None).cast("string")).alias("before_value"), (text("a", names) if a else F.lit(None).cast("string")).alias("after_value"))
    found = F.array(
        F.when(F.col("b").isNull(), row("ADDED_TARGET", cols, False, True)), F.when(F.col("a").isNull(), row("REMOVED_FROM_NEW_LIST", cols, True, False)),
        *[F.when(kept & differ(names), row(kind, names, True, True)) for kind, names in fields.items()],
    )
    return both.select(key, F.explode(F.array_compact(found)).alias("c")).select(key, "c.*")


def counters(rows: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """The same counts by several dimensions in one pass: dimension, key and a column for each of ``measures`` (conditions)."""
    exploded = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions]))
    r = rows.select(*[c.alias(n) for n, c in measures.items()], exploded.alias("d"))
    return r.groupBy("d.dimension", "d.key").agg(*[F.count_if(n).alias(n) for n in measures])


def readiness_blockers(superseded: Column, decision: Column, domain: Column, domain_active: Column, mapping: Column, mapping_active: Column, promoted: Column, compatible: Column, eligibility: Column, source_superseded: Column, scope_unresolved: Column) -> Column:
    """All that keeps a candidate from promotion, in the order to mend it; a missing fact counts against it."""
    good = lambda status, active: status.isin(*TRUSTED) & active
    no = lambda c: ~F.coalesce(c, F.lit(False))
    mapped = good(mapping, mapping_active)
    return F.array_compact(F.array(
        F.when(superseded, "NOT_CURRENT"), F.when(no(decision == "ACCEPTED"), "NOT_ACCEPTED"), F.when(no(good(domain, domain_active)), "DOMAIN_NOT_VERIFIED"),
        F.when(no(mapped), "RESPONSIBILITY_NOT_VERIFIED").when(no(promoted), "MAPPING_NOT_PROMOTED"), F.when(no(compatible), "RESPONSIBILITY_INCOMPATIBLE"),
        F.when(eligibility == "NOT_ELIGIBLE", "SOURCE_NOT_ELIGIBLE"), F.when(source_superseded, "SOURCE_SUPERSEDED"), F.when(scope_unresolved, "SCOPE_UNRESOLVED"),
    ))


def review_state(candidates: DataFrame, reviews: DataFrame, rule_versions: DataFrame, document_versions: DataFrame) -> DataFrame:
    """Each candidate with its two axes of currency, the latest decision on it and the number of its reviews."""
    r = reviews.groupBy("candidate_id").agg(F.max(F.struct("decided_at", "review_id", "decision")).alias("top"), F.count("*").alias("review_count"))
    c = candidates.join(F.broadcast(rule_versions), "extractor", "left").join(F.broadcast(document_versions), "document_extractor", "left").join(r, "candidate_id", "left")
    old = lambda current, own: ~F.coalesce(F.col(current) == F.col(own), F.lit(False))
    c = c.withColumns({"rule_superseded": old("rule_version", "version"), "document_superseded": old("document_version", "artifact_version")})
    gone = F.col("rule_superseded") | F.col("document_superseded")
    return c.select("candidate_id", "rule_superseded", "document_superseded", gone.alias("is_superseded"), (F.col("top").isNotNull() & gone).alias("review_superseded"), F.coalesce("top.decision", F.lit("UNREVIEWED")).alias("decision_state"), F.coalesce("review_count", F.lit(0)).alias("review_count"))


def references(rows: DataFrame, defined: DataFrame, ref: str, owner: str) -> DataFrame:
    """``rows`` with ``outcome`` of their reference: UNDEFINED, WRONG_OWNER or OK; ``defined`` has ref and owner."""
    d = defined.select(F.col(ref), F.col(owner).alias("defined_owner"))
    outcome = F.when(F.col("defined_owner").isNull(), "UNDEFINED").when(F.col("defined_owner") != F.col(owner), "WRONG_OWNER").otherwise("OK")
    return rows.join(d, ref, "left").withColumn("outcome", outcome)


def upsert_changed(existing: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """The register after an upsert, one row a key: ``action`` is INSERTED, UPDATED (the value differs, null-safe) or KEPT."""
    j = existing.select(key, F.col(value).alias("old"), F.lit(True).alias("had")).join(new.select(key, F.col(value).alias("new"), F.lit(True).alias("has")), key, "full")
    action = F.when(F.col("had").isNull(), "INSERTED").when(F.col("has") & ~F.col("old").eqNullSafe(F.col("new")), "UPDATED").otherwise("KEPT")
    return j.select(key, F.when(F.col("has"), F.col("new")).otherwise(F.col("old")).alias(value), action.alias("action"))


def chain_faults(log: DataFrame, content: Column) -> DataFrame:
    """Faults of a hash-chained log (seq, prev_hash, row_hash): seq and reason, the first that fits.

    Each row is compared with the row that has the number before it: an equi-join, no ordering of the
    whole log. A first number other than 1, or one without a predecessor, is a gap.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("row_hash").alias("expected"), F.lit(True).alias("found"))
    j = log.join(before, "seq", "left")
    reason = (
        F.when((F.col("seq") != 1) & F.col("found").isNull(), "GAP").when(~F.col("prev_hash").eqNullSafe(F.col("expected")), "PREV_HASH")
        .when(F.sha2(F.concat(F.coalesce("expected", F.lit("")), content), 256) != F.col("row_hash"), "ROW_HASH")
    )
    return j.select("seq", reason.alias("reason")).filter("reason is not null")
