"""Column functions over partial dates, fingerprints, names and addresses."""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimloom.functions.matches import let


def precision(year: Column, month: Column, day: Column, month_part: Column, time: Column) -> Column:
    """How much of a date is stated."""
    return F.when(year.isNull(), None).when(time.isNotNull(), "DATETIME").when(day.isNotNull(), "DATE").when(month_part.isNotNull(), "MONTH_PART").when(month.isNotNull(), "MONTH").otherwise("YEAR")


def date_range(year: Column, month: Column, day: Column) -> dict[str, Column]:
    """First day and the day after the last that a partial date may mean; null without a year or for a day that the month lacks."""
    m = F.when(month.between(1, 12), month)
    start = F.make_date(year, F.coalesce(m, F.lit(1)), F.lit(1))
    exact = day.between(1, 31) & m.isNotNull()
    real = day <= F.dayofmonth(F.last_day(start))
    lo = F.when(exact, F.when(real, F.date_add(start, F.greatest(day, F.lit(1)) - 1))).otherwise(start)
    hi = F.when(exact, F.when(real, F.date_add(start, F.greatest(day, F.lit(1))))).when(m.isNotNull(), F.add_months(start, 1)).otherwise(F.add_months(start, 12))
    return {"lo": lo, "hi": hi}


def list_fingerprint(parts: list[Column]) -> Column:
    """SHA-256 of a JSON list of strings with a blank behind each comma; quotes, backslashes and control characters are escaped."""
    quoted = [F.regexp_replace(F.to_json(F.array(p.cast("string"))), r"^\[|\]$", "") for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256)


#: Signs that are written in several ways, and those that can't be seen.
SIGNS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-"}
UNSEEN = "[\u200b-\u200f\u202a-\u202e\u2060\ufeff]"


@F.pandas_udf(StringType())
def _compatible(names: pd.Series) -> pd.Series:
    return names.map(lambda n: unicodedata.normalize("NFKC", n).casefold(), na_action="ignore").astype(object)


def name_key(name: Column) -> Column:
    """A name without what only its writing adds: width, case, quotes, dashes, white space and closing marks; null if nothing is left.

    Only names with a sign outside ASCII need Python, for the compatible form that columns can't make; all else is columns.
    """
    wide = name.rlike(r"[^\x00-\x7F]")
    folded = F.coalesce(_compatible(F.when(wide, F.regexp_replace(name, UNSEEN, ""))), F.lower(name))
    plain = F.translate(F.regexp_replace(folded, UNSEEN, ""), "".join(SIGNS), "".join(SIGNS.values()))
    spaced = F.trim(F.regexp_replace(plain, r"[\p{Z}\s\x1c-\x1f\x85]+", " "))
    out = F.trim(F.regexp_replace(spaced, r"[.,;:]+$", ""))
    return F.when(out != "", out)


# Ranges of addresses that aren't everyone's, from the public registries of special addresses, and where clouds give their machines' credentials.
V4_RANGES = [
    ("169.254.169.254/32", "METADATA"), ("100.100.100.200/32", "METADATA"), ("0.0.0.0/32", "UNSPECIFIED"), ("127.0.0.0/8", "LOOPBACK"), ("169.254.0.0/16", "LINK_LOCAL"), ("224.0.0.0/4", "MULTICAST"), ("240.0.0.0/4", "RESERVED"),
    ("192.0.0.9/32", "GLOBAL"), ("192.0.0.10/32", "GLOBAL"), ("10.0.0.0/8", "PRIVATE"), ("172.16.0.0/12", "PRIVATE"), ("192.168.0.0/16", "PRIVATE"), ("0.0.0.0/8", "PRIVATE"), ("192.0.0.0/24", "PRIVATE"), ("192.0.2.0/24", "PRIVATE"),
    ("198.18.0.0/15", "PRIVATE"), ("198.51.100.0/24", "PRIVATE"), ("203.0.113.0/24", "PRIVATE"), ("100.64.0.0/10", "NOT_GLOBAL"),
]
V6_RANGES = [
    ("fd00:ec2::254/128", "METADATA"), ("::/128", "UNSPECIFIED"), ("::1/128", "LOOPBACK"), ("fe80::/10", "LINK_LOCAL"), ("ff00::/8", "MULTICAST"), ("2001:1::1/128", "GLOBAL"), ("2001:1::2/128", "GLOBAL"), ("2001:3::/32", "GLOBAL"),
    ("2001:4:112::/48", "GLOBAL"), ("2001:20::/28", "GLOBAL"), ("2001:30::/28", "GLOBAL"), ("64:ff9b:1::/48", "PRIVATE"), ("100::/64", "PRIVATE"), ("2001::/23", "PRIVATE"), ("2001:db8::/32", "PRIVATE"), ("fc00::/7", "PRIVATE"),
    ("fec0::/10", "RESERVED"), ("::/8", "RESERVED"), ("100::/8", "RESERVED"), ("200::/7", "RESERVED"), ("400::/6", "RESERVED"), ("800::/5", "RESERVED"), ("1000::/4", "RESERVED"), ("4000::/2", "RESERVED"), ("8000::/2", "RESERVED"),
    ("c000::/3", "RESERVED"), ("e000::/4", "RESERVED"), ("f000::/5", "RESERVED"), ("f800::/6", "RESERVED"), ("fe00::/9", "RESERVED"),
]


def _hex_ends(network: str) -> tuple[str, str]:
    """First and last address of a range as hexadecimal digits of equal number, so that they compare as text."""
    n = ipaddress.ip_network(network)
    width = n.max_prefixlen // 4
    return f"{int(n.network_address):0{width}x}", f"{int(n.broadcast_address):0{width}x}"


def _kind_of(digits: Column, ranges: list[tuple[str, str]]) -> Column:
    """Kind of the first range that holds the address, GLOBAL if none does; null for a null."""
    in_ranges = lambda d: F.coalesce(*[F.when(d.between(*_hex_ends(r)), kind) for r, kind in ranges], F.when(d.isNotNull(), "GLOBAL"))
    return let(digits, in_ranges)


def _v4_digits(address: Column) -> Column:
    """Eight hexadecimal digits of a dotted address; null if it is none (parts above 255 or with a leading zero)."""
    part = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
    digits = F.array_join(F.transform(F.split(address, r"\."), lambda b: F.lpad(F.lower(F.hex(b.try_cast("int"))), 2, "0")), "")
    return F.when(address.rlike(rf"\A{part}(?:\.{part}){{3}}\z"), digits)


def _v6_digits(address: Column) -> Column:
    """32 hexadecimal digits of a colon address: a double colon stands for as many zeros as are missing, a dotted end for two groups; null if it is none."""
    none = F.array().cast("array<string>")
    # a zone behind a percent sign names the interface and isn't part of the address
    bare = F.lower(F.when(address.rlike(r"\A[^%]+%[^%]+\z"), F.substring_index(address, "%", 1)).otherwise(address))
    undotted = lambda a: let(_v4_digits(F.substring_index(a, ":", -1)), lambda d: F.coalesce(F.concat(F.regexp_replace(a, r"[^:]*\z", ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)), a))
    groups = lambda h: F.when(h == "", none).otherwise(F.split(h, ":", -1))

    def of_groups(halves: Column) -> Column:
        both = F.transform(halves, groups)
        filled = lambda b: F.when(F.size(b) == 1, b[0]).when(F.size(b) == 2, F.concat(b[0], F.array_repeat(F.lit("0"), 8 - F.size(b[0]) - F.size(b[1])), b[1]))
        # without a double colon there are eight groups, with one it stands for one or more
        count = F.aggregate(both, F.lit(0), lambda n, g: n + F.size(g))
        every = F.when(F.when(F.size(halves) == 1, count == 8).otherwise(count < 8), let(both, filled))
        fine = lambda e: F.when(F.forall(e, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")), F.array_join(F.transform(e, lambda g: F.lpad(g, 4, "0")), ""))
        return let(every, fine)

    return F.when(address.contains(":"), let(bare, lambda a: let(F.split(undotted(a), "::", -1), of_groups)))


def address_class(address: Column) -> Column:
    """GLOBAL, or why an address isn't, by the first range that holds it; INVALID if it is no address, null for a null.

    The kind of what an IPv6 address carries counts for it: mapped (the last 32 bits), 6to4 (those behind 2002) and Teredo (the last 32, inverted).
    """

    def of_v6(d: Column) -> Column:
        inverted = F.translate(F.substring(d, 25, 8), "0123456789abcdef", "fedcba9876543210")
        carried = F.when(d.startswith("0" * 20 + "ffff"), F.substring(d, 25, 8)).when(d.startswith("2002"), F.substring(d, 5, 8)).when(d.startswith("20010000"), inverted)
        return F.coalesce(_kind_of(carried, V4_RANGES), _kind_of(d, V6_RANGES))

    return F.when(address.isNotNull(), F.coalesce(_kind_of(_v4_digits(address), V4_RANGES), let(_v6_digits(address), of_v6), F.lit("INVALID")))


def same_name(a: Column, b: Column) -> Column:
    """Whether two names differ in their writing only."""
    return F.coalesce(name_key(a) == name_key(b), F.lit(False))


def warning_kind(text: Column) -> Column:
    """What a warning begins with: up to a colon or bracket, 60 characters at most."""
    return F.substring(F.trim(F.substring_index(F.substring_index(text, ":", 1), "(", 1)), 1, 60)
