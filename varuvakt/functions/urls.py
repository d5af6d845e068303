"""URL predicates and link extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host names and address ranges an alert may never be posted to.
LOCAL_HOST = "localhost"
LOCAL_SUFFIXES = (".localhost", ".internal", ".local")
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DOTTED_QUAD = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
NUMERIC_LAST_LABEL = r"(^|\.)(\d+|0x[0-9a-f]*)$"
#: What clients leave out of a URL: blanks and controls around it, line ends and tabs inside.
IGNORED = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
#: Host and port of an https URL; slashes may be backslashes, and a user may stand before the host.
TARGET = r"(?is)^https:[/\\]*(?:[^/\\?#]*@)?([^/\\?#@:]+)(?::(\d{0,5}))?(?:[/\\?#].*)?$"
NO_HOST_CHARACTER = r"[\x00-\x20<>\[\]^|%\x7f]"
ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
HREF = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*')"""


def safe_target_url(url: Column) -> Column:
    """True for an https URL whose host is public; NULL-safe, never raises.

    The host is read as clients read it; what follows it does not matter. A host
    whose last label is a number but which is not a plain dotted quad (a packed,
    octal or hexadecimal address) is refused, since clients resolve it to an
    address this test cannot see. So are hosts with percent signs and hosts with
    other than ASCII characters in their last label, which clients may map to a
    local name or an address.
    """
    cleaned = F.regexp_replace(url, IGNORED, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(cleaned, TARGET, 1)), r"\.$", "")
    port = F.regexp_extract(cleaned, TARGET, 2)
    quad = host.rlike(DOTTED_QUAD)
    a = F.regexp_extract(host, DOTTED_QUAD, 1).try_cast("int")
    b = F.regexp_extract(host, DOTTED_QUAD, 2).try_cast("int")
    private = (
        a.isin(0, 10, 127)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127))
    )
    local = host == LOCAL_HOST
    for suffix in LOCAL_SUFFIXES:
        local = local | host.endswith(suffix)
    opaque = ~quad & host.rlike(NUMERIC_LAST_LABEL)
    mapped = host.rlike(r"[^\x00-\x7f]") & ~host.rlike(r"\.[a-z][a-z0-9-]*$")
    malformed = (host == "") | host.rlike(NO_HOST_CHARACTER) | ((port != "") & (port.try_cast("int") > 65535))
    return F.coalesce(~(local | (quad & private) | opaque | mapped | malformed), F.lit(False))


def hrefs(html: Column) -> Column:
    """All quoted href values of a page, in document order, with their ampersands as such."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(HREF), 1),
        lambda q: F.replace(F.substr(q, F.lit(2), F.length(q) - 2), F.lit("&amp;"), F.lit("&")),
    )


def absolute_link(page_url: Column, href: Column) -> Column:
    """Resolve a link against its page; dot segments inside stay as they are.

    A page whose own address has no origin leaves relative links alone.
    """
    origin = F.regexp_extract(page_url, r"^([a-z]+://[^/?#]+)", 1)
    scheme = F.regexp_extract(page_url, r"^([a-z]+:)//", 1)
    page = F.regexp_extract(page_url, r"^[^?#]*", 0)
    folder = F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(href.rlike(ABSOLUTE) | (origin == ""), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when((href == "") | href.startswith("#"), F.concat(F.regexp_extract(page_url, r"^[^#]*", 0), href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )


def in_scope(link: Column, url_scope: Column, exclude_pattern: Column) -> Column:
    """Keep links under the scope prefix that do not contain the exclude text; empty means no limit."""
    scoped = (url_scope == "") | F.startswith(link, url_scope)
    excluded = (exclude_pattern != "") & F.contains(link, exclude_pattern)
    return scoped & ~excluded
