"""Expressions on skill names, credentials and proficiency levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.constants import CEFR_RANKS, CREDENTIAL_SEPARATORS, PROFICIENCY_PATTERNS
from talentloom.functions.strings import col, strip


def spelling_variants(c: Column | str) -> Column:
    """Ordered spellings under which a skill may be listed in the alias table."""
    base = F.lower(strip(c))
    space, dash, dot, none = F.lit(" "), F.lit("-"), F.lit("."), F.lit("")
    dotless = F.replace(base, dot, none)
    spellings = [
        version
        for text in (base, dotless)
        for version in (text, F.replace(text, space, dash), F.replace(text, space, none))
    ]
    return F.filter(F.array_distinct(F.array(*spellings)), lambda v: v != "")


def credential_tokens(c: Column | str) -> Column:
    """The whole lower-case credential and its parts: 'japanese - jlpt n3' adds 'jlpt n3'."""
    whole = F.lower(strip(c))
    parts = F.transform(F.split(whole, CREDENTIAL_SEPARATORS), strip)
    return F.filter(F.array_union(F.array(whole), parts), lambda t: t != "")


def proficiency(c: Column | str) -> Column:
    """struct(framework, rank) of the first matching framework, else null."""
    text = F.lower(col(c))
    found = None
    for framework, pattern in PROFICIENCY_PATTERNS:
        # Word characters are Unicode in the patterns' semantics, hence (?U).
        value = F.regexp_extract(text, "(?U)" + pattern, 1)
        if framework == "jlpt":
            rank = 6 - value.try_cast("double")
        elif framework == "cefr":
            rank = F.lit(None).cast("double")
            for level, number in CEFR_RANKS.items():
                rank = F.when(value == level, F.lit(float(number))).otherwise(rank)
        else:
            rank = value.try_cast("double")
        branch = F.struct(F.lit(framework).alias("framework"), rank.alias("rank"))
        found = F.when(value != "", branch) if found is None else found.when(value != "", branch)
    return found


def group_names(skill: Column, alternatives: Column) -> Column:
    """Names of an OR-group in order, blanks dropped."""
    names = F.concat(F.array(skill), F.coalesce(alternatives, F.array().cast("array<string>")))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def group_label(names: Column) -> Column:
    return F.array_join(F.array_distinct(names), " / ")
