"""Which extractors may read a page, whether it can be read, and where the wording of a claim stands in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extractors that a page's responsibility authorises; responsibilities that aren't here authorise none.
ROUTES = {
    "TUITION_FEES": ["tuition"], "LANGUAGE_REQUIREMENTS": ["language"], "APPLICATION_DEADLINES": ["deadline"], "PROGRAM_CATALOG": ["program"], "PROGRAM_PAGE": ["admission", "language", "program"],
    "ENTRY_REQUIREMENTS": ["admission", "language"], "UNDERGRADUATE_ADMISSIONS": ["admission", "deadline", "language"], "POSTGRADUATE_ADMISSIONS": ["admission", "deadline", "language"],
    "PHD_ADMISSIONS": ["admission", "deadline", "language"], "ACADEMIC_CALENDAR": ["calendar"],
}
# Least number of visible characters, categories of applicants that are a residency status, first bytes of a PDF.
USABLE_TEXT = 400
RESIDENCIES = ["DOMESTIC", "HOME", "INTERNATIONAL", "LOCAL", "NON_LOCAL", "OVERSEAS"]
PDF_MAGIC = "%PDF-"
#: White space of any kind.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def extractors_of(responsibility: Column) -> Column:
    """The extractors a responsibility authorises; an empty array for none, unknown and null ones."""
    routes = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(routes, responsibility), F.array().cast("array<string>"))


def authorised(claims: DataFrame, document: str, source_ref: str, responsibility: str) -> DataFrame:
    """One row for each document and extractor, under the responsibility with the least ``source_ref`` that authorises it.

    An extractor so runs once on a page, however many responsibilities ask for it. Documents without any have no row.
    """
    each = claims.select(document, F.explode(extractors_of(F.col(responsibility))).alias("extractor"), F.struct(source_ref, responsibility).alias("by"))
    return each.groupBy(document, "extractor").agg(F.min("by").alias("by")).select(document, "extractor", "by.*")


def violations(claims: DataFrame, responsibility: str, extractor: str) -> DataFrame:
    """Pairs of responsibility and extractor that occur among ``claims`` unauthorised, with their number of claims; a null on either side is unauthorised."""
    pairs = claims.groupBy(responsibility, extractor).agg(F.count("*").alias("claims"))
    return pairs.filter(~F.coalesce(F.array_contains(extractors_of(F.col(responsibility)), F.col(extractor)), F.lit(False)))


def usable(visible_text: Column) -> Column:
    """Whether a document has enough visible text for any extractor; null has none."""
    return F.coalesce(F.length(visible_text) >= USABLE_TEXT, F.lit(False))


def reader_of(content_type: Column, payload: Column) -> Column:
    """``pdf`` by the first bytes of a payload or else by its declared type, ``html`` otherwise."""
    declared = F.lower(F.trim(F.substring_index(content_type, ";", 1))) == "application/pdf"
    return F.when((F.substring(payload, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC).cast("binary")) | declared, "pdf").otherwise("html")


def hinted_scope(hint: Column) -> Column:
    """UNIVERSAL if the hint says just that; anything else, blank or not, needs a person."""
    return F.when(F.upper(F.trim(F.regexp_replace(hint, SPACE, " "))) == "UNIVERSAL", "UNIVERSAL").otherwise("SCOPE_MAPPING_REQUIRED")


def suggested_criteria(countries: Column, qualifications: Column, categories: Column) -> Column:
    """Criteria (dimension, value) that hints suggest: countries, qualifications, then categories that are a residency status, each sorted; null arrays suggest none."""
    def named(dimension: str, hints: Column) -> Column:
        known = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(hints, F.array().cast("array<string>")))))
        return F.transform(known, lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("value")))

    residency = F.filter(categories, lambda c: c.isin(RESIDENCIES))
    return F.concat(named("applicant_country", countries), named("qualification_type", qualifications), named("residency_status", residency))


def quote_place(quote: Column, cited: Column, blocks: Column) -> Column:
    """Number (from 0) of the block that holds ``quote``, white space aside: the cited one if it does, else the first; null if none does or the quote is blank."""
    folded = lambda c: F.trim(F.regexp_replace(c, SPACE, " "))
    needle = folded(quote)
    holds = F.transform(blocks, lambda b: F.coalesce(F.contains(folded(b), needle), F.lit(False)))
    first = F.array_position(holds, F.lit(True)).cast("int")
    return F.when(needle == "", None).when(F.get(holds, cited), cited.cast("int")).when(first > 0, first - 1)


def located(document: Column, locator: Column) -> Column:
    """The text that ``locator`` points at in ``document`` (see :mod:`.documents`: blocks, tables, links), null where it points at nothing.

    Fields of a locator: kind (table_cell, link, list_item, else a block), table_index, is_header_row, row_index,
    column_index, link_index, list_index with list_item_index, block_index with char_start and char_end (half-open, from 0).
    """
    at = locator.getField
    t = F.get(document["tables"], at("table_index"))
    cell = F.get(F.get(F.when(at("is_header_row"), t["header_rows"]).otherwise(t["rows"]), at("row_index")), at("column_index"))["text"]
    item = F.get(F.filter(document["blocks"], lambda b: b["list"] == at("list_index")), at("list_item_index"))["text"]
    text = F.get(document["blocks"], at("block_index"))["text"]
    part = F.when(at("char_start").isNotNull() & at("char_end").isNotNull(), F.substring(text, at("char_start") + 1, F.greatest(F.lit(0), at("char_end") - at("char_start")))).otherwise(text)
    return F.when(at("kind") == "table_cell", cell).when(at("kind") == "link", F.get(document["links"], at("link_index"))["text"]).when(at("kind") == "list_item", item).otherwise(part)
