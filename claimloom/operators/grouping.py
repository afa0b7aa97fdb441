"""Comparing claims: what each is about, what it says, and what all claims about one thing say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a key that stand for something not stated.
SENTINELS = ("UNRESOLVED", "PROGRAM_UNKNOWN", "PERIOD_NOT_STATED", "ROUND_NOT_STATED")


def context_key(parts: dict[str, Column], required: list[Column], comparable: Column) -> Column:
    """``name=value`` of every part, as an array; null where a required column is missing or empty, or the kind is never compared."""
    missing = ~comparable
    for c in required:
        missing = missing | c.isNull() | (c.cast("string") == "")
    return F.when(~missing, F.array(*[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in parts.items()]))


def is_thin(key: Column) -> Column:
    """Whether a part of the key stands for something not stated."""
    return F.exists(key, lambda p: F.regexp_extract(p, "=(.*)$", 1).isin(*SENTINELS))


def verdicts(claims: DataFrame, source: str) -> DataFrame:
    """Groups of ``claims`` (key, value_key, kind, comparable): kind, verdict, n_claims, n_values, n_sources.

    Claims without a key are groups of their own. A source that isn't known counts as one unknown source. Claims are counted by key, value and source first, so
    neither a frequent key nor several distinct counts multiply rows.
    """
    each = claims.filter("key is not null").groupBy("kind", "key", "value_key", F.coalesce(F.col(source).cast("string"), F.lit("?")).alias("__source")).agg(F.count("*").alias("n"))
    of_values = each.groupBy("kind", "key", "value_key").agg(F.sum("n").alias("n")).groupBy("kind", "key").agg(F.count("value_key").alias("n_values"), F.sum("n").alias("n_claims"))
    of_sources = each.select("kind", "key", "__source").distinct().groupBy("kind", "key").agg(F.count("*").alias("n_sources")).withColumnsRenamed({"kind": "__kind", "key": "__key"})
    keyed = of_values.join(of_sources, of_values["kind"].eqNullSafe(F.col("__kind")) & (of_values["key"] == F.col("__key"))).drop("__kind", "__key")
    thin, several = is_thin(F.col("key")), F.col("n_values") > 1
    verdict = (
        F.when(several & ~thin, "CONFLICTS").when(several, "INSUFFICIENT_CONTEXT").when(F.col("n_claims") == 1, "SINGLE").when(F.col("n_sources") > 1, "AGREES").otherwise("POSSIBLE_DUPLICATE")
    )
    one = lambda n: F.lit(1).cast("long").alias(n)
    alone = claims.filter("key is null").select("kind", F.when(F.col("comparable"), "INSUFFICIENT_CONTEXT").otherwise("NOT_COMPARABLE").alias("verdict"), one("n_claims"), one("n_values"), one("n_sources"))
    return keyed.select("kind", verdict.alias("verdict"), "n_claims", "n_values", "n_sources").union(alone)


def unconfirmed(groups: DataFrame) -> DataFrame:
    """Groups of several values whose context is too thin to call that a conflict."""
    return groups.filter((F.col("verdict") == "INSUFFICIENT_CONTEXT") & (F.col("n_values") > 1))


def context_conflicts(claims: DataFrame, subject: list[str], components: list[str]) -> DataFrame:
    """One value in two contexts or more, where every component that differs is stated in all of them: subject, n_contexts, differing (names)."""
    stated = [F.min(~F.coalesce(F.col(c).cast("string").isin(*SENTINELS), F.lit(True))).alias(f"s_{c}") for c in components]
    several = [F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(f"n_{c}") for c in components]
    g = claims.select(*subject, *components).distinct().groupBy(*subject).agg(F.count("*").alias("n_contexts"), *stated, *several).filter("n_contexts > 1")
    differing = F.array_compact(F.array(*[F.when(F.col(f"n_{c}"), F.lit(c)) for c in components]))
    all_stated = F.lit(True)
    for c in components:
        all_stated = all_stated & (~F.col(f"n_{c}") | F.col(f"s_{c}"))
    return g.filter(all_stated).select(*subject, "n_contexts", F.array_join(differing, ",").alias("differing"))
