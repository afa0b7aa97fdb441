"""Claims of the same thing by several sources: agreement, corroboration, coverage and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def agreement(claims: DataFrame, key: list[str], value: str, source: str, thin: str | None = None) -> DataFrame:
    """Verdict per context: conflicts, thin context, single, agreeing sources or a repeat by one source.

    A key with a null part is no context; its claims are left to :func:`unkeyed`.
    """
    keyed = claims.na.drop(subset=key)
    g = keyed.groupBy(*key).agg(F.countDistinct(value).alias("n_values"), F.countDistinct(source).alias("n_sources"), F.count("*").alias("n_claims"), F.max(F.col(thin) if thin else F.lit(False)).alias("thin"))
    verdict = (
        F.when((F.col("n_values") > 1) & ~F.col("thin"), "CONFLICTS").when(F.col("n_values") > 1, "INSUFFICIENT_CONTEXT")
        .when(F.col("n_claims") == 1, "SINGLE").when(F.col("n_sources") > 1, "AGREES").otherwise("POSSIBLE_DUPLICATE")
    )
    return g.withColumn("verdict", verdict).drop("thin")


def unkeyed(claims: DataFrame, key: list[str]) -> DataFrame:
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    return claims.filter(missing)


def verdict_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("verdict").agg(F.count("*").alias("groups"), F.sum("n_claims").alias("claims"))


def corroborated(claims: DataFrame, key: list[str], value: str, source: str, id_: str) -> DataFrame:
    """Claims whose value another source gives in the same context; the counts are joined back, so no group's ids are gathered."""
    g = claims.groupBy(*key, value).agg(F.countDistinct(source).alias("n_sources")).filter("n_sources > 1")
    return claims.join(g, [*key, value]).filter(F.col(id_).isNotNull()).select(id_, "n_sources")


def best_band(claims: DataFrame, group: list[str], band: str) -> DataFrame:
    """Each claim beside the best band of its group."""
    rank = F.when(F.col(band) == "HIGH", 3).when(F.col(band) == "MEDIUM", 2).otherwise(1)
    return claims.withColumn("best_band", F.max(rank).over(Window.partitionBy(*group)))


def flags_by(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One boolean per kind whether the key has a row of it: one aggregate for many EXISTS tests."""
    return rows.groupBy(key).agg(*[F.max(F.col(kind) == k).alias(f"has_{k.lower().replace('-', '_').replace('.', '').replace(' ', '_')}") for k in kinds])


def either_key(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], id_left: str, id_right: str) -> DataFrame:
    """Pairs that match on any of several keys: one equi-join per key, united, instead of an OR condition."""
    out = None
    for a, b in on:
        one = left.join(right, left[a] == right[b]).select(left[id_left], right[id_right])
        out = one if out is None else out.union(one)
    return out.distinct()
