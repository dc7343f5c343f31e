"""Time scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO-8601 as produced by isoformat(): the fraction is optional.
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"

# Zone names of RFC 822 and their offsets; '' is a date without a zone.
ZONES = {"": "+0000", "Z": "+0000", "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "EST": "-0500", "EDT": "-0400",
         "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_iso_time(s: Column, default: Column | None = None) -> Column:
    """ISO string -> timestamp; NULL input falls back to ``default`` (now)."""
    d = F.current_timestamp() if default is None else default
    return F.when(s.isNull(), d).otherwise(F.try_to_timestamp(s, F.lit(ISO_PATTERN)))


def parse_feed_time(s: Column) -> Column:
    """RFC-822 feed date (``Mon, 05 Feb 2024 10:00:00 -0500``) or ISO date -> timestamp.

    The weekday is dropped first (weekday patterns are refused when parsing).
    A zone is an offset or one of RFC 822's names; without one the date is UTC.
    """
    no_day = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3},\s*", "")
    zone = F.upper(F.regexp_extract(no_day, r"\s([A-Za-z]{1,3}|[+-]\d{2}:?\d{2})$", 1))
    names = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    offset = F.coalesce(names[zone], F.replace(zone, F.lit(":"), F.lit("")))
    body = F.regexp_replace(no_day, r"\s+([A-Za-z]{1,3}|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(
        F.try_to_timestamp(F.concat_ws(" ", body, offset), F.lit("d MMM yyyy HH:mm[:ss] xx")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
        F.try_to_timestamp(s, F.lit(ISO_PATTERN)),
    )


def entry_time(published: Column, updated: Column, now: Column) -> Column:
    """Entry timestamp: published, else updated, else ``now``."""
    return F.coalesce(published.cast("timestamp"), updated.cast("timestamp"), now)


def fmt_ts(c: Column) -> Column:
    """Timestamp -> 'yyyy-MM-dd HH:mm:ss.SSSSSS' (stable text for comparisons)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
