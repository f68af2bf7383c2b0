"""Dates kept as text in several formats; ages are counted from an explicit moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = "yyyy-MM-dd"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
ISO_OFFSET = "yyyy-MM-dd'T'HH:mm:ss[XXX][XX][X]"
BLANK_SECONDS = "yyyy-MM-dd HH:mm:ss"
HTTP_TAIL = "dd MMM yyyy HH:mm:ss 'GMT'"


def as_moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.to_timestamp(F.lit(str(as_of)))


def first_parsed(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def sitemap_date(c: Column) -> Column:
    """ISO date, ISO date-time with or without offset, or blank-separated date-time."""
    return first_parsed(c, ISO_OFFSET, ISO_SECONDS, BLANK_SECONDS, ISO_DATE)


def page_date(c: Column) -> Column:
    """ISO date, ISO date-time (an offset after ``+`` is ignored) or HTTP date."""
    head = F.trim(F.split(c, r"\+")[0])
    http = F.when(head.rlike("^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), "), F.substring(head, 6, 30))
    return F.coalesce(first_parsed(head, ISO_DATE, ISO_SECONDS), F.try_to_timestamp(http, F.lit(HTTP_TAIL)))


def lastmod_date(c: Column) -> Column:
    """Sitemap ``lastmod``: the first 19 characters as date-time, else as date."""
    t = F.trim(c)
    return first_parsed(F.substring(t, 1, 19), ISO_SECONDS, ISO_DATE)


def days_between(moment: Column, as_of: Column) -> Column:
    """Whole days elapsed, rounded down."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(moment)) / F.lit(86400000000)).cast("int")
