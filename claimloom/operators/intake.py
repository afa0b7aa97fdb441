"""Taking sources in and changing what is done with them: registration, recovery actions, rounds of deadlines, counts for reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.matches import places

# Kind of source by the category of a page.
SOURCE_TYPES = {
    "UNIVERSITY_HOME": "university_site", "PROGRAM_CATALOG": "university_site", "PROGRAM_PAGE": "university_site", "ACADEMIC_CALENDAR": "university_site", "UNDERGRADUATE_ADMISSIONS": "admissions_page",
    "POSTGRADUATE_ADMISSIONS": "admissions_page", "PHD_ADMISSIONS": "admissions_page", "ENTRY_REQUIREMENTS": "admissions_page", "LANGUAGE_REQUIREMENTS": "admissions_page", "APPLICATION_DEADLINES": "admissions_page",
    "FACULTY_OR_SCHOOL": "faculty_site", "TUITION_FEES": "fee_page", "OFFICIAL_PDF": "official_pdf", "GOVERNMENT": "government_regulator", "AUTHORIZED_RANKING": "authorized_ranking",
}
#: A round is named by what it is like, one or several words, before what it is; or by its number.
QUALITIES = ["first", "second", "third", "fourth", "final", "main", "priority", "early", "regular", "late", "restrictive", "single choice", "spring", "autumn"]
NOUNS = ["round", "decision", "action", "intake"]
_ROUND = rf"(?i)\b(?:round\s+\d+|(?:(?:{'|'.join(q.replace(' ', '[ -]') for q in QUALITIES)})\s+)+(?:{'|'.join(NOUNS)})|priority)\b"
#: Two years with a line between them, the second in two or four digits; the year of an entry.
_YEARS, _ENTRY = r"(?<!\d)(20\d{2}\s?[/–—-]\s?(?:20)?\d{2})(?!\d)", r"(?i)(?<!\d)(20\d{2})\s+(?:entry|start)\b"


def registered(claims: DataFrame, known: DataFrame) -> DataFrame:
    """One source for each ``url_hash`` of ``claims`` (url_hash, url, source_ref, category, rejection), the least source_ref giving its facts.

    Columns: url_hash, source_ref, source_type, fetch_strategy, fetch_eligibility, claims (that link to it), is_new (``known`` lacks its hash). Rows without a hash are left out.
    """
    first = F.min(F.struct("source_ref", "category", "url", "rejection")).alias("first")
    one = claims.filter("url_hash is not null").groupBy("url_hash").agg(first, F.count("*").alias("claims"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv]), F.coalesce(F.col("first.category"), F.lit(""))), F.lit("unclassified"))
    old = known.select("url_hash", F.lit(False).alias("is_new")).distinct()
    return one.join(old, "url_hash", "left").select(
        "url_hash", F.col("first.source_ref").alias("source_ref"), kind.alias("source_type"), F.when(F.lower("first.url").endswith(".pdf"), "DOCUMENT").otherwise("STATIC").alias("fetch_strategy"),
        F.when(F.col("first.rejection").isNull(), "FETCHABLE").otherwise("NEEDS_MANUAL_REVIEW").alias("fetch_eligibility"), "claims", F.coalesce("is_new", F.lit(True)).alias("is_new"),
    )


def recovered(sources: DataFrame, actions: DataFrame) -> DataFrame:
    """``sources`` (source_id, is_active, fetch_eligibility, access_state, cooldown_until) after ``actions`` (source_id, action_id, action) in the order of their ids.

    REENABLE of an inactive source is refused; otherwise it makes the source fetchable, its access OK and ends its pause, which CLEAR_COOLDOWN does alone.
    DISABLE and NEEDS_REVIEW set the eligibility only. ``refused`` counts the refusals. Only the latest action of each sort decides, so no history is ordered.
    """
    a = actions.join(sources.select("source_id", "is_active"), "source_id")
    at = F.col("action_id")
    sets = F.col("action").isin("DISABLE", "NEEDS_REVIEW") | ((F.col("action") == "REENABLE") & F.col("is_active"))
    last = a.groupBy("source_id").agg(
        F.max(F.when(sets, F.struct(at, "action"))).alias("set"), F.max(F.when((F.col("action") == "REENABLE") & F.col("is_active"), True)).alias("enabled"),
        F.max(F.when(F.col("action") == "CLEAR_COOLDOWN", True)).alias("cleared"), F.count_if((F.col("action") == "REENABLE") & ~F.col("is_active")).alias("refused"),
    )
    now = F.when(F.col("set.action") == "REENABLE", "FETCHABLE").when(F.col("set.action") == "DISABLE", "DISABLED").when(F.col("set.action") == "NEEDS_REVIEW", "NEEDS_MANUAL_REVIEW")
    return sources.join(last, "source_id", "left").select(
        "source_id", "is_active", F.coalesce(now, "fetch_eligibility").alias("fetch_eligibility"), F.when(F.col("enabled"), "OK").otherwise(F.col("access_state")).alias("access_state"),
        F.when(F.coalesce("enabled", "cleared", F.lit(False)), None).otherwise(F.col("cooldown_until")).alias("cooldown_until"), F.coalesce("refused", F.lit(0)).alias("refused"),
    )


def _round_in(text: Column) -> Column:
    """The round that stands first in ``text``, in lower case with single blanks; null without one."""
    return F.regexp_replace(F.lower(F.get(places(text, _ROUND), F.lit(0))["match"]), r"[\s-]+", " ")


def deadline_context(text: Column, heading: Column) -> dict[str, Column]:
    """``round_label`` with its ``source`` (text before heading), ``round_number`` if stated, ``academic_year`` and ``entry_year`` (heading before text)."""
    said, above = _round_in(text), _round_in(heading)
    label, both = F.coalesce(said, above), F.concat_ws("\n", heading, text)
    none = lambda c: F.when(c != "", c)
    return {
        "round_label": label, "round_source": F.when(said.isNotNull(), "text").when(above.isNotNull(), "heading"), "round_number": none(F.regexp_extract(label, r"^round (\d+)$", 1)).cast("int"),
        "academic_year": none(F.regexp_extract(both, _YEARS, 1)), "entry_year": none(F.regexp_extract(both, _ENTRY, 1)).cast("int"),
    }


def blocker_matrix(claims: DataFrame, institution: str, kind: str, blockers: str) -> DataFrame:
    """Counts of an institution's claims in one pass: all of them, ready ones (without a blocker), each blocker, and both by kind."""
    k, ready = F.col(kind).cast("string"), F.size(blockers) == 0
    cell = lambda d, key: F.struct(F.lit(d).alias("dimension"), key.alias("key"))
    cells = [cell("CURRENT", F.lit("all")), cell("CURRENT_OF_KIND", k), F.when(ready, cell("READY", F.lit("all"))), F.when(ready, cell("READY_OF_KIND", k))]
    all_cells = F.concat(F.array_compact(F.array(*cells)), F.transform(blockers, lambda b: cell("BLOCKER", b)))
    return claims.select(institution, F.explode(all_cells).alias("c")).groupBy(institution, "c.dimension", "c.key").agg(F.count("*").alias("claims"))


def scope_vocabulary(claims: DataFrame, scopes: str, example: str, order: str) -> DataFrame:
    """Wordings of nested ``scopes`` (array of struct with marker and kind): uses and the example of the claim that comes first; null and empty arrays state none."""
    s = claims.select(F.explode(scopes).alias("s"), F.substring(example, 1, 110).alias("e"), F.col(order).alias("o"))
    return s.groupBy(F.col("s.marker").alias("marker"), F.col("s.kind").alias("kind")).agg(F.count("*").alias("uses"), F.min_by("e", "o").alias("example"))
