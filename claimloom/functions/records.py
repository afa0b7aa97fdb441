"""Column functions over what fetches record and what claims are known by: addresses, headers, places, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.matches import let

# Query parameters whose values are credentials, and what is written in their stead.
SECRET = ("access_token", "auth", "authorization", "code", "id_token", "jsessionid", "key", "password", "refresh_token", "session", "sessionid", "sid", "sig", "signature", "token")
MASK = "%5Bredacted%5D"
# Response headers that are kept, and how much of each.
KEPT = ("cache-control", "content-disposition", "content-language", "content-length", "content-type", "date", "etag", "expires", "last-modified", "location", "retry-after", "server")
KEPT_LENGTH = 512
# What lists call the places, by code.
REGIONS = {"英国": "GB", "美国": "US", "澳大利亚": "AU", "加拿大": "CA", "新加坡": "SG", "新西兰": "NZ", "中国香港": "HK", "香港": "HK", "中国澳门": "MO", "澳门": "MO", "爱尔兰": "IE", "马来西亚": "MY"}
TERRITORIES = {
    "United Kingdom": "GB", "United States of America": "US", "United States": "US", "Australia": "AU", "Canada": "CA", "Singapore": "SG", "New Zealand": "NZ", "Hong Kong SAR, China": "HK",
    "Hong Kong SAR": "HK", "Macao SAR, China": "MO", "Macau SAR, China": "MO", "Ireland": "IE", "Malaysia": "MY",
}


def _decoded(part: Column) -> Column:
    """A form-encoded part as text; a percent sign that begins no escape stands for itself."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def redacted(url: Column) -> Column:
    """``url`` with the values of credential parameters masked; its query is written anew only if it has one."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    secret = lambda p: F.lower(_decoded(name(p))).isin(*SECRET)
    value = lambda p: F.when(secret(p), F.lit(MASK)).otherwise(_encoded(_decoded(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1))))
    again = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(_decoded(name(p))), F.lit("="), value(p))), "&")
    whole = F.concat(F.regexp_extract(url, r"^([^?#]*\?)", 1), again, F.regexp_extract(url, "(?s)(#.*)$", 1))
    return F.when(F.exists(pairs, secret), whole).otherwise(url)


def kept_headers(headers: Column) -> Column:
    """The headers of a map that are kept, cut to a length; null if none is."""
    kept = F.transform_values(F.map_filter(headers, lambda k, _: F.lower(k).isin(*KEPT)), lambda _, v: F.substring(v, 1, KEPT_LENGTH))
    return F.when(F.cardinality(kept) > 0, kept)


def destination(region: Column, territory: Column) -> dict[str, Column]:
    """``code`` of the place that two labels name, or the ``problem``: UNRECOGNISED, NO_LABEL, or DISAGREE where they name two."""
    look = lambda names, c: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.trim(F.coalesce(c, F.lit(""))))
    a, b = look(REGIONS, region), look(TERRITORIES, territory)
    code = F.when(a.isNotNull() & b.isNotNull() & (a != b), None).otherwise(F.coalesce(a, b))
    said = (F.trim(F.coalesce(region, F.lit(""))) != "") | (F.trim(F.coalesce(territory, F.lit(""))) != "")
    problem = F.when(code.isNotNull(), None).when(a.isNotNull(), "DISAGREE").when(said, "UNRECOGNISED").otherwise("NO_LABEL")
    return {"code": code, "problem": problem}


def ascii_json(value: Column) -> Column:
    """JSON without blanks whose signs outside of printable ASCII are escaped; names come in the order of the struct.

    Control characters whose escapes hold letters are written with capitals (``\\u001F``). Only the different signs that a text has outside ASCII are replaced, each in one go.
    """
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit("[^ -~]"), F.lit(0))), t, lambda s, c: F.replace(s, c, units(c)))
    return let(F.to_json(value), lambda t: F.when(t.rlike("[^ -~]"), escaped(t)).otherwise(t))


def claim_fingerprint(extraction: Column, kind: Column, locator: dict[str, Column], extractor: Column, version: Column) -> Column:
    """SHA-256 over where a claim was found and by which rule, never over what it says; parts of a locator that are null are left out."""
    place = F.struct(*[locator[n].alias(n) for n in sorted(locator)])
    return F.sha2(ascii_json(F.struct(extraction.cast("string").alias("extraction_id"), extractor.alias("extractor"), kind.alias("field_kind"), place.alias("locator"), version.alias("version"))), 256)


def body_confirmation(locator_kind: Column, container: Column) -> Column:
    """Whether a claim stands in the body of its page."""
    return (
        F.when(locator_kind == "link", "NOT_RECORDED").when(container.isin("main", "article", "pdf"), "CONFIRMED")
        .when(container.isin("aside", "form"), "PERIPHERAL").otherwise("UNCONFIRMED")
    )
