"""Which of two claims' scopes governs, for all claims of a context, by sets of criteria.

A scope with more criteria is narrower and governs; of equal ones that which a person settled. Claims of one context whose scopes are the same are one set,
with their number; sets are compared, not claims, so the work grows with the claims and with the different sets of a context alone. Membership tells which
claims a set has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = ["context", "criteria", "publishable", "human"]


def scope_sets(claims: DataFrame) -> DataFrame:
    """The different scopes of each context: context, criteria (sorted), publishable, human, claims (their number).

    ``claims``: context, claim_id, criteria (array of strings), publishable (its state may be published), human (a person settled it). Null criteria are none, null flags are false; rows without a context are left out.
    """
    c = claims.filter("context is not null").select("context", F.array_sort(F.array_distinct(F.coalesce("criteria", F.array().cast("array<string>")))).alias("criteria"), F.coalesce("publishable", F.lit(False)).alias("publishable"), F.coalesce("human", F.lit(False)).alias("human"))
    return c.groupBy(*_KEY).agg(F.count("*").alias("claims"))


def verdict(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """NOT_PUBLISHABLE, EQUIVALENT, LEFT_WINS, RIGHT_WINS or INCOMPARABLE for two scopes (criteria, publishable, human)."""
    common = F.size(F.array_intersect(left["criteria"], right["criteria"]))
    n, m = F.size(left["criteria"]), F.size(right["criteria"])
    same = (common == n) & (common == m)
    by_person = F.when(left["human"] == right["human"], "EQUIVALENT").when(left["human"], "LEFT_WINS").otherwise("RIGHT_WINS")
    return F.when(~left["publishable"] | ~right["publishable"], "NOT_PUBLISHABLE").when(same, by_person).when(common == n, "RIGHT_WINS").when(common == m, "LEFT_WINS").otherwise("INCOMPARABLE")


def verdicts(sets: DataFrame) -> DataFrame:
    """The verdict for every two scopes of a context, each pair once (the lesser by criteria, publishable and human is left), and for two claims of one scope if it has several.

    Columns: context, left_criteria, right_criteria, left_claims, right_claims (for one scope: the number and one less), verdict.
    """
    side = lambda name: sets.select("context", F.struct("criteria", "publishable", "human").alias(name), F.col("claims").alias(f"{name}_claims"))
    pairs = side("left").join(side("right"), "context").filter((F.col("left") < F.col("right")) | ((F.col("left") == F.col("right")) & (F.col("left_claims") > 1)))
    parts = lambda name: {c: F.col(f"{name}.{c}") for c in _KEY[1:]}
    own = F.col("left") == F.col("right")
    return pairs.select(
        "context", F.col("left.criteria").alias("left_criteria"), F.col("right.criteria").alias("right_criteria"), "left_claims", F.when(own, F.col("right_claims") - 1).otherwise(F.col("right_claims")).alias("right_claims"), verdict(parts("left"), parts("right")).alias("verdict"),
    )


def governing_sets(sets: DataFrame) -> DataFrame:
    """Per context the criteria that govern all its claims, or null: those of a scope of one claim that wins against every other, with all publishable.

    The winner's criteria hold those of every other scope, so it is found by counting, without pairs.
    """
    every = sets.select("context", F.explode("criteria").alias("c")).groupBy("context").agg(F.countDistinct("c").alias("all"))
    s = sets.join(every, "context", "left").withColumn("top", F.size("criteria") == F.coalesce("all", F.lit(0)))
    person = F.col("top") & F.col("human")
    g = s.groupBy("context").agg(
        F.min("publishable").alias("publishable"), F.sum(F.when(F.col("top"), F.col("claims")).otherwise(0)).alias("tops"), F.sum(F.when(person, F.col("claims")).otherwise(0)).alias("persons"), F.max(F.when(F.col("top"), F.col("criteria"))).alias("criteria"),
    )
    return g.select("context", F.when(F.col("publishable") & ((F.col("tops") == 1) | (F.col("persons") == 1)), F.col("criteria")).alias("criteria"))
