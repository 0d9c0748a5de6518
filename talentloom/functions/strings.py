"""String helpers with Unicode-aware trimming and binary-exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.constants import WHITESPACE, WHITESPACE_CLASS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def count_words(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(f"[^{WHITESPACE_CLASS}]+"))


def fixed(c: Column | str, digits: int) -> Column:
    """Decimal text of a double, half-even on its exact binary value."""
    return F.replace(F.format_number(col(c), digits), F.lit(","), F.lit(""))


def half_even(c: Column | str, digits: int) -> Column:
    """Round like `fixed`, back to double. Differs from bround on e.g. 2.675."""
    return fixed(c, digits).cast("double")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    found = c.contains(words[0])
    for word in words[1:]:
        found = found | c.contains(word)
    return found


def last_segment(c: Column | str, separator: str) -> Column:
    return F.element_at(F.split(col(c), separator, -1), -1)
