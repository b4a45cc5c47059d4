"""URL parts as column expressions; null in, null out, and null for what is no absolute URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1)), F.lit(""))


def origin(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _PREFIX + "[^/?#]*", 0)), F.lit(""))


def host(url: Column) -> Column:
    return F.substring_index(origin(url), "://", -1)


def _after_host(url: Column, pattern: str) -> Column:
    """The part of the path that ``pattern`` catches in one pass, always beginning with '/'."""
    caught = F.regexp_replace(url, "(?s)" + _PREFIX + "[^/?#]*" + pattern, "$1")
    return F.when(url.rlike(_PREFIX), F.concat(F.lit("/"), F.substring(caught, 2, 1 << 30)))


def raw_path(url: Column) -> Column:
    return _after_host(url, r"([^?#]*)([?#].*)?$")


def path(url: Column) -> Column:
    """The path without trailing slashes, '/' for the root."""
    return _after_host(url, r"([^?#]*?)/*([?#].*)?$")


def page_key(url: Column) -> Column:
    """Comparable identity of a page: origin and trimmed path."""
    return F.concat(origin(url), path(url))


def host_path(url: Column) -> Column:
    return F.concat(host(url), path(url))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for a reference found on the page ``base``; dot segments of one level are folded."""
    h = F.trim(href)
    folder = F.regexp_replace(raw_path(base), "[^/]*$", "")
    joined = F.concat(origin(base), folder, h)
    folded = F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"/[^/]+/\.\./", "/")
    return (
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin(base), h))
        .when((h == "") | h.startswith("#"), F.substring_index(base, "#", 1))
        .when(h.startswith("?"), F.concat(origin(base), raw_path(base), h))
        .otherwise(folded)
    )


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def same_site(a: Column, b: Column) -> Column:
    return bare_host(a) == bare_host(b)


#: Path segments of pages kept out of search on purpose.
UTILITY_SEGMENTS = (
    "login log-in signin sign-in signup sign-up register logout log-out signout sign-out account my-account profile settings dashboard admin "
    "auth oauth callback password forgot-password reset-password verify cart basket checkout thank-you thanks confirmation search unsubscribe "
    "preview preorder pre-order waitlist"
).split()


def is_utility(trimmed_path: Column) -> Column:
    """Whether a segment, without .html or .php, is one of UTILITY_SEGMENTS."""
    segments = F.transform(F.split(F.lower(trimmed_path), "/"), lambda s: F.regexp_replace(s, r"\.(html?|php)$", ""))
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in UTILITY_SEGMENTS]))
