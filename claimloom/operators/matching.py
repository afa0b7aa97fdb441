"""Rows of workbooks to institutions by id, with suggestions by name, and what hosts and titles say for an institution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.values import name_key

# Words of institutions' names that tell nothing in a host, and the letters that a telling word has at least.
STOP = ["university", "the", "of", "college", "institute", "school", "national", "state", "at", "and", "for", "technology", "science", "sciences", "hong"]
LETTERS = 4
#: Suggestions of a row at most (a report's limit).
SUGGESTED = 10
_ID = r"(?i)^\{?(?:urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def name_tokens(name: Column) -> Column:
    """Different words of a name, of ASCII letters in lower case, that are long enough and tell something; sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= LETTERS) & ~w.isin(*STOP))))


def host_evidence(pages: DataFrame) -> DataFrame:
    """What pages say for their host being an institution's: institution, host, pages, host_tokens, titles, naming_titles.

    ``pages``: institution (its name), host, title. ``host_tokens``: the name's telling words that the host holds; ``titles``: different titles,
    ``naming_titles``: those that hold such a word. Words are looked up in the row that names them, so nothing is paired.
    """
    tokens = name_tokens(F.col("institution"))
    holds = lambda text: F.filter(tokens, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))
    per = pages.groupBy("institution", "host", "title").agg(F.count("*").alias("n"))
    named = F.col("title").isNotNull() & (F.col("title") != "")
    return per.groupBy("institution", "host").agg(
        F.sum("n").alias("pages"), F.first(holds(F.col("host"))).alias("host_tokens"), F.count_if(named).alias("titles"), F.count_if(named & (F.size(holds(F.col("title"))) > 0)).alias("naming_titles"),
    )


def parsed_id(raw: Column) -> Column:
    """An id's 32 digits with lines between them, from any way of writing it; null if it is none."""
    digits = F.lower(F.regexp_replace(F.trim(raw), r"(?i)[{}-]|urn:uuid:", ""))
    parts = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(F.trim(raw).rlike(_ID), parts)


def resolutions(rows: DataFrame, institutions: DataFrame) -> DataFrame:
    """What each row's id leads to: row, outcome, institution_id (if RESOLVED), candidates (ids of institutions that its name stands for).

    ``rows``: row, raw_id, raw_name; ``institutions``: institution_id, name, other_name. RESOLVED needs an id that exists; a name alone never resolves. Without an
    id a row is AMBIGUOUS_NAME if its name stands for several institutions, else MISSING_ID; an id that is none is MALFORMED_ID, one that no institution has UNKNOWN_ID.
    Names are compared by their keys, exactly; of many institutions of one key the first ``SUGGESTED`` by name and id are suggested, so a name that many rows have joins one row.
    """
    keys = institutions.select("institution_id", "name", F.explode(F.array_distinct(F.array_compact(F.array(name_key(F.col("name")), name_key(F.col("other_name")))))).alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("name", "institution_id"))
    few = keys.withColumn("nth", nth).filter(F.col("nth") <= SUGGESTED)
    by_key = few.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "institution_id"))), lambda x: x["institution_id"]).alias("candidates"))
    known = institutions.select(F.col("institution_id").alias("known")).distinct()
    r = rows.withColumns({"id": parsed_id(F.col("raw_id")), "key": name_key(F.col("raw_name"))})
    r = r.join(known, r["id"] == known["known"], "left").join(by_key, "key", "left")
    blank = F.coalesce(F.trim("raw_id"), F.lit("")) == ""
    outcome = (
        F.when(blank & (F.size(F.coalesce("candidates", F.array())) > 1), "AMBIGUOUS_NAME").when(blank, "MISSING_ID").when(F.col("id").isNull(), "MALFORMED_ID")
        .when(F.col("known").isNull(), "UNKNOWN_ID").otherwise("RESOLVED")
    )
    none = F.array().cast("array<string>")
    return r.withColumn("outcome", outcome).select("row", "outcome", F.col("known").alias("institution_id"), F.when(F.col("outcome") == "RESOLVED", none).otherwise(F.coalesce("candidates", none)).alias("candidates"))
