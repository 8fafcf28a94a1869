"""URL parts, predicates and audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SPACE, col, finding, findings, strip

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*"
_BAD_CHARS = rf"[{SPACE}\x00-\x1f]"

# fixed value: the strict URL shape of the URL split report
STRICT_URL = (
    r"^https?://[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*(:[0-9]{1,5})?(/[^\s]*)?$"
)


def _plain(url: Column) -> Column:
    # line breaks and tabs never separate URL parts
    return F.translate(url, "\t\r\n", "")


def scheme(url: Column | str) -> Column:
    """Lower-case scheme, ``""`` if absent."""
    return F.lower(F.regexp_extract(_plain(col(url)), f"^({_SCHEME}):", 1))


def netloc(url: Column | str) -> Column:
    """Authority part with user info, port and case kept, ``""`` if absent."""
    return F.regexp_extract(_plain(col(url)), f"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    """Path without parameters, query and fragment."""
    raw = F.regexp_extract(_plain(col(url)), f"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, ";[^/]*$", "")


def site(url: Column | str) -> Column:
    """``scheme://netloc``: the key robots rules are stored under."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def _unparsable(host: Column) -> Column:
    return F.contains(host, F.lit("[")) != F.contains(host, F.lit("]"))


def is_valid(url: Column | str) -> Column:
    """http(s) scheme, a domain with a dot, no white space or control characters; no trimming."""
    u = col(url)
    host = netloc(u)
    ok = (
        scheme(u).isin("http", "https")
        & F.contains(host, F.lit("."))
        & ~_unparsable(host)
        & ~u.rlike(_BAD_CHARS)
    )
    return F.coalesce(ok, F.lit(False))


def is_strict(url: Column | str) -> Column:
    """Whether the whole text has the strict URL shape."""
    return F.coalesce(col(url).rlike(STRICT_URL), F.lit(False))


def audit(url: Column | str) -> Column:
    """Every URL problem as a findings array; the text is trimmed first."""
    raw = col(url)
    u = strip(raw)
    host, sch = netloc(u), scheme(u)
    given = raw.isNotNull() & (raw != "")
    readable = given & ~_unparsable(host)
    return findings(
        [
            finding(~given, "url", "required", "URL is required", raw),
            finding(
                given & u.rlike(_BAD_CHARS),
                "url",
                "format",
                "URL contains invalid characters (spaces or control chars)",
                u,
            ),
            finding(given & _unparsable(host), "url", "format", "Invalid URL format: Invalid IPv6 URL", u),
            finding(
                readable & ~sch.isin("http", "https"),
                "url",
                "scheme",
                F.concat(F.lit("URL scheme must be http or https, got: "), sch),
                u,
            ),
            finding(readable & (host == ""), "url", "format", "URL must have a domain", u),
            finding(
                readable & (host != "") & ~F.contains(host, F.lit(".")),
                "url",
                "format",
                "URL domain must contain at least one dot (e.g., example.com)",
                u,
            ),
        ]
    )
