"""Column functions over URLs and markup text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host: scheme, path, query, fragment and port cut off."""
    return F.lower(F.split_part(F.regexp_replace(url, "^[^:]+://([^/?#]*).*$", "$1"), F.lit(":"), F.lit(1)))


def authority(url: Column) -> Column:
    """What stands between the scheme and the first slash, port and query kept."""
    return F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))


def registrable(host_: Column, long_suffixes: tuple[str, ...] = ("co.uk", "ac.uk", "edu.cn", "com.cn", "edu.hk", "edu.au")) -> Column:
    """Last two labels of a host, or three under a two-label suffix."""
    parts = F.split(host_, r"\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    long = F.lit(False)
    for s in long_suffixes:
        long = long | host_.endswith("." + s)
    return F.when(F.size(parts) < 2, host_).when(long & (F.size(parts) >= 3), last(3)).otherwise(last(2))


def title(html: Column) -> Column:
    """Text of the first title element, white space folded, 300 characters at most."""
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(F.trim(F.regexp_replace(inner, r"\s+", " ")), 1, 300)


def fold_space(text: Column) -> Column:
    """Runs of ASCII white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """A stated wait within 1 to 3600 s, else 15 s doubled per attempt up to 300 s."""
    return F.when(retry_after.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(3600), retry_after))).otherwise(F.least(F.lit(300), (15 * F.pow(F.lit(2.0), attempt - 1)).cast("int")))


# Names that no public site has, ports that one may use, and the form of a DNS name.
RESERVED_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "metadata")
RESERVED_SUFFIX = r"\.(localhost|local|localdomain|internal|intranet|corp|home|lan|test|example|invalid|onion)$"
PORTS = ("80", "443", "8080", "8443")
DNS_NAME = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"
LONGEST_URL = 2048


def canonical(url: Column) -> dict[str, Column]:
    """``rejection`` (null for a URL that may be stored) and ``canonical`` (null for others) of ASCII URLs.

    Scheme and host are lower-cased, a default port and the fragment go, an empty path is a slash;
    path and query stay as written. Names outside ASCII are rejected as BAD_HOST.
    """
    u = F.trim(url)
    part = lambda pattern: F.regexp_extract(u, pattern, 1)
    scheme = F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*):"))
    netloc = part(r"^[^:/?#]+://([^/?#]*)")
    name = F.lower(F.regexp_replace(F.regexp_replace(netloc, r":[^:\]]*$", ""), r"\.$", ""))
    port = F.regexp_extract(netloc, r":([^:\]]*)$", 1)
    path = part(r"^[^:/?#]+://[^/?#]*([^?#]*)")
    query = part(r"^[^?#]*(\?[^#]*)")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    rejection = (
        F.when(u.isNull() | (u == ""), "EMPTY").when(F.length(u) > LONGEST_URL, "TOO_LONG").when(u.rlike(r"[\s\x00-\x1f\x7f]"), "FORBIDDEN_CHARACTER")
        .when(~scheme.isin("http", "https"), "SCHEME").when(F.contains(netloc, F.lit("@")), "CREDENTIALS").when(netloc == "", "NO_HOST")
        .when(netloc.startswith("["), "IP_LITERAL").when(name.rlike(r"^\d+(\.\d+){3}$"), "IP_LITERAL").when(~name.rlike(DNS_NAME) & ~name.isin(*RESERVED_HOSTS), "BAD_HOST")
        .when(name.rlike(r"(^|\.)\d+$"), "NUMERIC_SUFFIX").when(name.isin(*RESERVED_HOSTS) | name.rlike(RESERVED_SUFFIX), "RESERVED_HOST")
        .when((port != "") & ~port.isin(*PORTS), "PORT")
    )
    shown = F.when(default | (port == ""), "").otherwise(F.concat(F.lit(":"), port))
    whole = F.concat(scheme, F.lit("://"), name, shown, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return {"rejection": rejection, "canonical": F.when(rejection.isNull(), whole)}
