"""Whole-text measures and the labelled job text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.constants import (
    DEGREE_RANKS,
    EDUCATION_TERMS,
    WORD_PATTERN,
)
from talentloom.functions.cleaning import degree_rank
from talentloom.functions.strings import col, count_words, fixed, is_blank, strip, text_or_empty


def clean_text(c: Column | str) -> Column:
    text = F.replace(col(c), F.lit("\0"), F.lit(" "))
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return strip(text)


def text_quality(c: Column | str) -> dict[str, Column]:
    """Columns score, reasons (joined by '; ') and word_count of a text."""
    text = col(c)
    chars = F.length(text)
    words = F.regexp_count(text, F.lit(WORD_PATTERN))
    letters = chars - F.length(F.regexp_replace(text, WORD_PATTERN, ""))
    garbage = chars - F.length(F.replace(text, F.lit("�"), F.lit("")))
    mean = F.try_divide(letters, words)
    short, few = chars < 100, words < 30
    noisy = (chars > 0) & (garbage / F.greatest(chars, F.lit(1)) > 0.02)
    odd = (words > 0) & ((mean < 2) | (mean > 15))

    def penalty(flag: Column, points: int) -> Column:
        return F.when(flag, points).otherwise(0)

    score = 100 - penalty(short, 60) - penalty(few, 30) - penalty(noisy, 20) - penalty(odd, 15)
    reasons = F.concat_ws(
        "; ",
        F.when(short, "text too short"),
        F.when(few, "too few words"),
        F.when(noisy, "high garbage char ratio"),
        F.when(odd, F.concat(F.lit("abnormal avg word length "), fixed(mean, 1))),
    )
    return {"score": F.greatest(score, F.lit(0)), "reasons": reasons, "word_count": words}


def text_stats(c: Column | str) -> dict[str, Column]:
    text = col(c)
    sentences = F.regexp_count(text, F.lit("[.!?]"))
    return {
        "chars": F.length(text),
        "words": count_words(text),
        "sentences": F.greatest(sentences, F.lit(1)),
    }


def labelled(label: str, value: Column, separator: str = " ") -> Column:
    """'Label: value', or null when the value is blank."""
    return F.when(~is_blank(value), F.concat(F.lit(f"{label}:{separator}"), strip(value)))


def job_posting_text(
    title: Column,
    work_type: Column,
    location: Column,
    education: Column,
    required: Column,
    preferred: Column,
    nice_to_have: Column,
    experience: Column,
    responsibilities: Column,
    requirements: Column,
    benefits: Column,
) -> Column:
    """Ordered labelled blocks separated by a blank line; empty blocks are left out."""
    return F.concat_ws(
        "\n\n",
        labelled("Job Title", title),
        labelled("Work Type", work_type),
        labelled("Location", location),
        labelled("Education", education),
        labelled("Required Skills", required),
        labelled("Preferred Skills", preferred),
        labelled("Nice to Have Skills", nice_to_have),
        labelled("Experience Requirement", experience),
        labelled("Responsibilities", responsibilities, "\n"),
        labelled("Requirements", requirements, "\n"),
        labelled("Benefits", benefits, "\n"),
    )


def tagged_line(c: Column | str, label: str) -> Column:
    """Value of the first 'Label: value' line, null when there is none."""
    return F.nullif(strip(F.regexp_extract(col(c), rf"(?m)^{label}:[ \t]*([^\n]*)$", 1)), F.lit(""))


def tagged_list(c: Column | str, label: str) -> Column:
    items = F.transform(F.split(tagged_line(c, label), ","), strip)
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def tagged_fields(c: Column | str) -> dict[str, Column]:
    """The deterministic part of reading a labelled job text back into fields."""
    kind = F.lower(tagged_line(c, "Work Type"))
    segments = F.split(tagged_line(c, "Location"), ",")
    before_last = F.slice(segments, F.lit(1), F.size(segments) - 1)
    def term_rank(term: Column) -> Column:
        level = None
        for word, name in EDUCATION_TERMS.items():
            level = (F if level is None else level).when(F.lower(strip(term)) == word, DEGREE_RANKS[name])
        return level

    ranks = F.transform(F.split(tagged_line(c, "Education"), ","), term_rank)
    years = F.regexp_extract(text_or_empty(tagged_line(c, "Experience Requirement")), r"(\d+)", 1)
    return {
        "title": tagged_line(c, "Job Title"),
        "work_mode": F.when(kind.isin("hybrid", "remote"), kind)
        .when(kind.isin("onsite", "on-site"), "onsite")
        .otherwise("onsite"),
        "city_text": strip(F.element_at(segments, -1)),
        "raw_address": strip(F.array_join(before_last, ",")),
        "education_rank": F.coalesce(F.array_min(F.array_compact(ranks)), F.lit(0)),
        "required_skills": tagged_list(c, "Required Skills"),
        "preferred_skills": tagged_list(c, "Preferred Skills"),
        "nice_to_have_skills": tagged_list(c, "Nice to Have Skills"),
        "min_years": F.coalesce(F.nullif(years, F.lit("")).try_cast("int"), F.lit(0)),
    }


def job_narrative(title: Column, responsibilities: Column, years: Column, level: Column) -> Column:
    label = F.initcap(F.replace(level, F.lit("_"), F.lit(" ")))
    return F.concat_ws(
        "\n",
        title,
        F.when(text_or_empty(responsibilities) != "", responsibilities),
        F.when(years > 0, F.format_string("Experience: minimum %d years", years)),
        F.when(degree_rank(level) > 0, F.concat(F.lit("Education: "), label, F.lit(" or above"))),
    )
