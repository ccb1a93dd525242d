"""Time helpers as Column expressions, in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filename_datetime(name: Column) -> Column:
    """Date and time in a file's base name: separated form first, then compact; an invalid one falls to the next (S-01)."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    separated = r"(\d{4})[-._](\d{2})[-._](\d{2})[ T_.@-]+(\d{2})[-:._h]?(\d{2})[-:._m]?(\d{2})"
    compact = r"(?<!\d)(\d{4})(\d{2})(\d{2})[ T_-]?(\d{2})(\d{2})(\d{2})(?!\d)"

    def read(pattern: str) -> Column:
        part = lambda k: F.regexp_extract(base, pattern, k)
        text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))

    return F.coalesce(read(separated), read(compact))


def utc_iso(col: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` (S-03)."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_time(*choices: tuple[str, Column, bool]) -> Column:
    """The first time there is, with its source's name and whether it is an absolute instant (S-02)."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.cast("timestamp").alias("at"), F.lit(name).alias("source"), F.lit(absolute).alias("absolute"))) for name, c, absolute in choices])


def whole_seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds, fractions cut off towards zero."""
    return ((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1000000).cast("long")
