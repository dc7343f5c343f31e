"""URL scalar functions (Column -> Column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import QUERY_FRAGMENT_PATTERN, URL_BLOCKLIST

# scheme://[userinfo@]host[:port]...; group 2 is the host.
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)"


def strip_query(uri: Column) -> Column:
    """Drop everything from the first ``?`` or ``#`` (canonical article URL)."""
    # every match is removed (global replace), as with the fixed pattern
    return F.regexp_replace(uri, QUERY_FRAGMENT_PATTERN, "")


def url_host(uri: Column) -> Column:
    """Lower-case host without port or user info; NULL when there is none.

    Written as a pattern rather than ``parse_url``, which keeps upper case and
    rejects hosts containing ``_``.
    """
    return F.nullif(F.lower(F.regexp_extract(uri, HOST_PATTERN, 2)), F.lit(""))


def is_blocked(uri: Column, patterns: list[str] | None = None) -> Column:
    """True if any pattern matches at the start of the raw URI (``re.match``)."""
    pats = URL_BLOCKLIST if patterns is None else patterns
    if not pats:
        return F.lit(False)
    # re.match anchors at the start only; '.' does not cross newlines.
    return reduce(lambda a, b: a | b, [uri.rlike("^(?:" + p + ")") for p in pats])
