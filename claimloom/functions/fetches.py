"""Column functions over what servers answer: when to come back, and whether the answer is a challenge instead of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# What pages of challenges hold, and the bytes that such a page has at most.
CHALLENGES = ["_Incapsula_Resource", "Just a moment...", "cf-browser-verification", "/cdn-cgi/challenge-platform", "Attention Required! | Cloudflare", "DDoS protection by"]
CHALLENGE_BYTES = 8 * 1024
_DATE = r"(?i)^\s*(?:[a-z]+,\s*)?(\d{1,2})[\s-]([a-z]{3})[a-z]*[\s-](\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(gmt|utc?|z|[+-]\d{4})?\s*$"


def http_date(text: Column) -> Column:
    """The moment of a date as HTTP writes it (with or without a weekday, years of two digits from 1969 on); null if it is none.

    Without a zone it is meant in Greenwich time. Days that a month lacks and times that no day has give null.
    """
    part = lambda i: F.regexp_extract(text, _DATE, i)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part(2))).cast("int")
    year = part(3).try_cast("int")
    year = F.when(F.length(part(3)) == 2, F.when(year >= 69, 1900 + year).otherwise(2000 + year)).otherwise(year)
    day, hour, minute, second = (part(i).try_cast("int") for i in (1, 4, 5, 6))
    first = F.make_date(year, F.when(month > 0, month), F.lit(1))
    fine = (F.length(part(3)) != 3) & (day >= 1) & (day <= F.dayofmonth(F.last_day(first))) & (hour < 24) & (minute < 60) & (F.coalesce(second, F.lit(0)) < 60)
    zone = F.when(part(7).rlike(r"^[+-]"), F.when(part(7).startswith("-"), -1).otherwise(1) * (F.substring(part(7), 2, 2).try_cast("int") * 3600 + F.substring(part(7), 4, 2).try_cast("int") * 60)).otherwise(0)
    seconds = F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + (day - 1) * 86400 + hour * 3600 + minute * 60 + F.coalesce(second, F.lit(0)) - zone
    return F.when(text.rlike(_DATE) & fine, F.timestamp_seconds(seconds))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait that a Retry-After header asks for at the moment ``now``: a whole number, or a date; never less than 0. Null if it says neither."""
    number = F.regexp_extract(value, r"^\s*([+-]?\d+)\s*$", 1).try_cast("double")
    until = (F.unix_millis(http_date(value)) - F.unix_millis(now)) / F.lit(1000.0)
    return F.greatest(F.lit(0.0), F.coalesce(number, until)) + F.when(F.coalesce(number, until).isNull(), None).otherwise(0.0)


def challenge(body: Column, content_type: Column) -> Column:
    """What shows that a small HTML body (binary) is a challenge, the first that it holds; null for a page."""
    base = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    text = F.decode(body, "ISO-8859-1")
    found = F.coalesce(*[F.when(F.contains(text, F.lit(m)), m) for m in CHALLENGES])
    return F.when(base.isin("text/html", "application/xhtml+xml", "") & (F.octet_length(body) <= CHALLENGE_BYTES), found)


def evidence_relation(resolved: Column, raw: Column, evidence: Column) -> Column:
    """How the text that a locator leads to relates to a claim's own wording, the best of seven.

    UNRESOLVED without a text; EXACT_RAW, CONTAINS_RAW or ALL_RAW_TOKENS_PRESENT by what the claim took; EQUALS_EVIDENCE or WITHIN_EVIDENCE (either way round) by what it quotes; else MISMATCH. White space at the ends of raw and evidence doesn't count.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    r, e, own = strip(raw), strip(evidence), strip(resolved)
    tokens = F.split(r, r"[\s\x1c-\x1f\x85\p{Z}]+")
    return (
        F.when(resolved.isNull(), "UNRESOLVED").when(resolved == r, "EXACT_RAW").when((r != "") & F.contains(resolved, r), "CONTAINS_RAW")
        .when((r != "") & F.forall(tokens, lambda t: F.contains(resolved, t)), "ALL_RAW_TOKENS_PRESENT").when(own == e, "EQUALS_EVIDENCE")
        .when((e != "") & (F.contains(e, own) | F.contains(own, e)), "WITHIN_EVIDENCE").otherwise("MISMATCH")
    )
