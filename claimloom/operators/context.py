"""Claims that one place of a document states together: groups of programmes and of language tests, their shapes, and how well locators lead back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.fetches import evidence_relation

# Kinds of claims that a group may hold.
PROGRAM_KINDS = ["PROGRAM_NAME", "DEGREE_LEVEL", "DISCIPLINE_HINT", "DURATION", "STUDY_MODE", "CAMPUS", "FACULTY_OR_SCHOOL"]
LANGUAGE_KINDS = ["LANGUAGE_TEST", "LANGUAGE_OVERALL_SCORE", "LANGUAGE_COMPONENT_SCORE"]


def program_anchor() -> Column:
    """The place of a claim: its locator's kind and those of its numbers that are there."""
    numbers = [F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in ("block_index", "list_item_index", "table_index", "row_index", "link_index")]
    return F.concat_ws("/", "locator_kind", *numbers)


def language_anchor() -> Column:
    """The block, the item of its list and the test: one paragraph may name several tests, and these stay apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat(F.lit("block="), text("block_index"), F.lit("/item="), text("list_item_index"), F.lit("/test="), text("test"))


def context_groups(claims: DataFrame, kinds: list[str], anchor: Column) -> DataFrame:
    """Groups of claims of ``kinds`` from one place of one extraction: extraction_id, anchor, members, kinds (different ones, sorted), institution and url of the least claim.

    ``claims``: claim_id, extraction_id, institution, url, kind, locator_kind, test and the numbers of locators. A group's members are counted, not gathered.
    """
    c = claims.filter(F.col("kind").isin(kinds)).withColumn("anchor", anchor)
    first = F.min(F.struct("claim_id", "institution", "url"))
    g = c.groupBy("extraction_id", "anchor").agg(F.count("*").alias("members"), F.array_sort(F.collect_set("kind")).alias("kinds"), first.alias("f"))  # at most as many kinds as there are
    return g.select("extraction_id", "anchor", "members", "kinds", F.col("f.institution").alias("institution"), F.col("f.url").alias("url"))


def group_shapes(groups: DataFrame) -> DataFrame:
    """How many groups have which number of members and which kinds."""
    return groups.groupBy("members", F.array_join("kinds", "+").alias("kinds")).agg(F.count("*").alias("groups"))


def evidence_integrity(claims: DataFrame) -> DataFrame:
    """Claims by kind (and in all, kind null) and by how the text their locator leads to relates to their wording. ``claims``: kind, resolved, raw, evidence."""
    r = claims.select("kind", evidence_relation(F.col("resolved"), F.col("raw"), F.col("evidence")).alias("relation"))
    return r.groupingSets([["kind", "relation"], ["relation"]], "kind", "relation").agg(F.grouping("kind").alias("whole"), F.count("*").alias("claims")).select("kind", F.col("whole").cast("boolean").alias("whole"), "relation", "claims")
