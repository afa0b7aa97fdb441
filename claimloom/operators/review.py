"""Review of claims: priority with its reasons, queue, publication blockers and the scope that governs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of each reason for reviewing a claim earlier or later.
POINTS = {
    "high_risk_field": 40, "confidence_high": 25, "confidence_medium": 15, "corroborated": 20, "body_confirmed": 10, "has_evidence": 5,
    "scope_unresolved": -20, "in_conflict": -15, "thin_source": -25, "body_unconfirmed": -10, "confidence_low": -20,
}
# Eligibility of a source whose claims may be published.
ELIGIBLE = ("OFFICIAL_VERIFIED", "AUTHORIZED_EXTERNAL", "AUTHORIZED_RANKING")


def with_priority(claims: DataFrame, band: str, facts: dict[str, Column]) -> DataFrame:
    """``score`` and ``reasons`` (names in the order of ``POINTS``); a null or missing fact does not count.

    ``facts`` gives conditions by the names in ``POINTS``; confidence comes from ``band``, everything but HIGH and MEDIUM being low.
    """
    b = F.coalesce(F.col(band), F.lit("LOW"))
    known = facts | {"confidence_high": b == "HIGH", "confidence_medium": b == "MEDIUM", "confidence_low": ~b.isin("HIGH", "MEDIUM")}
    used = [(n, F.coalesce(known[n], F.lit(False))) for n in POINTS if n in known]
    score = sum((F.when(c, F.lit(POINTS[n])).otherwise(0) for n, c in used), F.lit(0))
    return claims.withColumns({"score": score, "reasons": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in used]))})


def queue(band: Column, superseded: Column, decision: Column, only_candidate: Column) -> Column:
    """Queue of a claim: decided and superseded ones have none, a weak one counts if it is all there is."""
    done = F.coalesce(superseded, F.lit(False)) | ~F.coalesce(decision == "UNREVIEWED", F.lit(False))
    return F.when(done, "NOT_QUEUED").when(band.isin("HIGH", "MEDIUM"), "PRIMARY").when(only_candidate, "ONLY_CANDIDATE").otherwise("LOW_CONFIDENCE")


def blockers(superseded: Column, decision: Column, eligibility: Column, scope_unresolved: Column, in_conflict: Column, authorised: Column) -> Column:
    """All that keeps a claim from publication; an empty array if nothing does."""
    return F.array_compact(F.array(
        F.when(superseded, "SUPERSEDED_RULE_VERSION"), F.when(decision != "ACCEPTED", F.concat(F.lit("REVIEW_STATE_IS_"), decision)),
        F.when(~eligibility.isin(*ELIGIBLE), F.concat(F.lit("SOURCE_"), eligibility)), F.when(scope_unresolved, "SCOPE_UNRESOLVED"),
        F.when(in_conflict, "UNRESOLVED_CONFLICT"), F.when(~authorised, "RESPONSIBILITY_DOES_NOT_AUTHORISE_FIELD"),
    ))


def scope_state(jurisdiction: Column, qualification: Column, universal: Column) -> Column:
    """State that the criteria of a scope amount to; without any, only a stated ``universal`` makes it one."""
    return (
        F.when(jurisdiction.isNotNull() & qualification.isNotNull(), "JURISDICTION_AND_QUALIFICATION").when(jurisdiction.isNotNull(), "APPLICANT_JURISDICTION")
        .when(qualification.isNotNull(), "QUALIFICATION_SYSTEM").when(universal, "UNIVERSAL_EXPLICIT").otherwise("UNSCOPED")
    )


def governing(scopes: DataFrame, key: str, id_: str, criteria: str, human: str, state: str) -> DataFrame:
    """Per ``key`` the scope that wins against all others, or null.

    A narrower scope wins, so the winner holds every criterion of its group; among scopes of
    equal criteria a single one settled by a person wins. An unscoped row leaves its group open. Two
    aggregates find this, without comparing pairs.
    """
    exploded = scopes.select(key, F.explode(criteria).alias("c")).groupBy(key).agg(F.countDistinct("c").alias("all_criteria"))
    known = scopes.join(exploded, key, "left").withColumn("top", F.size(F.array_distinct(criteria)) == F.coalesce("all_criteria", F.lit(0)))
    by_person = F.col("top") & F.col(human)
    g = known.groupBy(key).agg(
        F.count("*").alias("n_scopes"), F.count_if(F.col("top")).alias("n_top"), F.count_if(by_person).alias("n_person"), F.count_if(F.col(state) == "UNSCOPED").alias("n_unscoped"),
        F.min(F.when(F.col("top"), F.col(id_))).alias("one"), F.min(F.when(by_person, F.col(id_))).alias("person"),
    )
    winner = F.when(F.col("n_unscoped") > 0, None).when(F.col("n_top") == 1, F.col("one")).when(F.col("n_person") == 1, F.col("person"))
    return g.select(key, "n_scopes", winner.alias("governing_id"))
