"""Month-resolution dates as integers: year * 12 + month - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.constants import MONTH_PATTERN, PRESENT_TOKENS
from talentloom.functions.strings import col, strip


def month_number(text: str) -> int:
    year, month = text.split("-")[:2]
    return int(year) * 12 + int(month) - 1


def is_present(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*PRESENT_TOKENS), F.lit(False))


def parse_month(c: Column | str, as_of: str) -> Column:
    """Month index of 'YYYY-MM' style text; null when blank or not a date."""

    def read(text: Column) -> Column:
        year = _int(F.regexp_extract(text, MONTH_PATTERN, 1))
        month = F.coalesce(_int(F.regexp_extract(text, MONTH_PATTERN, 2)), F.lit(1))
        index = year * 12 + F.least(F.greatest(month, F.lit(1)), F.lit(12)) - 1
        return F.when(text.isin(*PRESENT_TOKENS), F.lit(month_number(as_of))).when(year > 0, index)

    # Bound once through a one-element array; as plain columns the cleaned text
    # would be worked out again at each of its uses.
    return F.transform(F.array(F.lower(strip(c))), read)[0]


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def months_between(start: Column | str, end: Column | str, as_of: str) -> Column:
    """Whole months from start to end; unknown sides fall back to the as-of month."""
    now = F.lit(month_number(as_of))
    s = F.coalesce(parse_month(start, as_of), now)
    e = F.coalesce(parse_month(end, as_of), now)
    return F.greatest(e - s, F.lit(0))


def span(start: Column | str, end: Column | str, as_of: str) -> tuple[Column, Column]:
    """(start, end) month indexes of a job; end never precedes start."""
    s = parse_month(start, as_of)
    e = F.coalesce(parse_month(end, as_of), F.lit(month_number(as_of)))
    return s, F.greatest(e, s)


def month_text(index: Column | str) -> Column:
    i = col(index)
    return F.format_string("%04d-%02d", (F.floor(i / 12)).cast("int"), (i % 12 + 1).cast("int"))
