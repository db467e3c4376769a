"""Dates in texts, as column expressions over ISO strings; '' is no date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

SEPARATED = "(20[0-9]{2})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})"
SPACED = r"(20[0-9]{2})[-/.年]\s*([0-9]{1,2})[-/.月]\s*([0-9]{1,2})"
COMPACT = "(20[0-9]{2})([0-9]{2})([0-9]{2})"
HEAD = 1000


def _iso(match: Column, pattern: str) -> Column:
    part = lambda i, width: F.lpad(F.regexp_extract(match, pattern, i), width, "0")
    return F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))


def publish_date(title: Column, content: Column, url: Column) -> Column:
    """The first valid date in address, title and the head of the content: separated ones before compact ones."""
    haystack = F.concat_ws(" ", text(url), text(title), F.substring(text(content), 1, HEAD))
    matches = lambda pattern: F.transform(F.regexp_extract_all(haystack, F.lit(pattern), 0), lambda m: _iso(m, pattern))
    found = F.concat(matches(SEPARATED), matches(COMPACT))
    valid = F.filter(found, lambda d: d.try_cast("date").isNotNull())
    return F.coalesce(F.try_element_at(valid, F.lit(1)), F.lit(""))


def first_raw_date(value: Column) -> Column:
    return F.regexp_extract(text(value), SEPARATED, 0)


def normalized_date(value: Column) -> Column:
    """The first date-like match, zero-padded and not validated."""
    match = F.regexp_extract(text(value), SPACED, 0)
    return F.when(match != "", _iso(match, SPACED)).otherwise("")


def date_argument(value: str | None, name: str) -> date | None:
    if not value:
        return None
    try:
        return date.fromisoformat(value)
    except ValueError as error:
        raise ValueError(f"{name} must be a date as YYYY-MM-DD") from error


def in_window(value: Column, first: date | None, last: date | None) -> Column:
    """Inside the window, or no readable date at all."""
    day = text(value)
    day = F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day).try_cast("date")
    inside = F.lit(True)
    if first is not None:
        inside = inside & (day >= F.lit(first))
    if last is not None:
        inside = inside & (day <= F.lit(last))
    return F.coalesce(inside, F.lit(True))
