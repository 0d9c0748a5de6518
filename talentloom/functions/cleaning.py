"""Normalising expressions for candidate and job fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.constants import (
    CITY_KEYWORDS,
    DEFAULT_CITY,
    DEFAULT_WEIGHTS,
    DEFAULT_WORK_MODE,
    DEGREE_KEYWORDS,
    DEGREE_NULL_TOKENS,
    DEGREE_RANKS,
    DIMENSIONS,
    FILENAME_HEADER,
    GENERIC_SKILLS,
    HANOI_ABBREVIATION,
    MIN_TEXT_QUALITY,
    WEIGHT_SUM_TOLERANCE,
    WORK_MODES,
)
from talentloom.functions.strings import col, contains_any, is_blank, last_segment, strip


def degree(c: Column | str) -> Column:
    """Degree level of free text; first matching keyword group wins."""
    c = col(c)
    text = strip(F.lower(c))
    level = F.when(c == "", F.lit(None).cast("string")).when(text.isin(*DEGREE_RANKS), text)
    for name, words in DEGREE_KEYWORDS:
        level = level.when(contains_any(text, words), F.lit(name))
    return level.when(c.isNotNull(), F.lit("other"))


def degree_rank(level: Column | str) -> Column:
    level = col(level)
    rank = None
    for name, value in DEGREE_RANKS.items():
        rank = (rank if rank is not None else F).when(level == name, F.lit(value))
    return F.coalesce(rank, F.lit(0))


def job_degree(c: Column | str) -> Column:
    """Required degree: null tokens mean no requirement, the rest stays as given."""
    c = col(c)
    return F.when(~strip(F.lower(c)).isin(*DEGREE_NULL_TOKENS), c)


def job_degree_is_valid(c: Column | str) -> Column:
    level = job_degree(c)
    return level.isNull() | level.isin(*DEGREE_RANKS)


def candidate_city(c: Column | str) -> Column:
    text = strip(F.lower(col(c)))
    city = F.when(text == HANOI_ABBREVIATION, F.lit(CITY_KEYWORDS[0][0]))
    for name, words in CITY_KEYWORDS:
        city = city.when(contains_any(text, words), F.lit(name))
    return city


def job_city(c: Column | str) -> Column:
    return F.coalesce(candidate_city(c), F.lit(DEFAULT_CITY))


def work_mode(c: Column | str) -> Column:
    mode = strip(F.lower(col(c)))
    return F.when(mode.isin(*WORK_MODES), mode).otherwise(F.lit(DEFAULT_WORK_MODE))


def min_years(c: Column | str) -> Column:
    """Ceiling of the number; blank or unparsable is 0, and so is a negative one. Beyond
    the range of an int it is the largest int."""
    text = strip(col(c).cast("string"))
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text).try_cast("double")
    held = F.least(F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0)), F.lit(2.0**31 - 1))
    return F.ceil(held).cast("int")


def non_blank_or_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), col(c))


def skill_key(c: Column | str) -> Column:
    """Lookup key: lower case, punctuation to space, runs of space to one."""
    words = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(words, r"\s+", " "))


def is_generic_skill(c: Column | str) -> Column:
    return skill_key(c).isin(*GENERIC_SKILLS)


def json_name_or_text(item: Column) -> Column:
    """A list entry that is text, or an object with a name or a title."""
    name = F.get_json_object(item, "$.name")
    title = F.get_json_object(item, "$.title")
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(title, F.lit("")), item)


def url_is_valid(c: Column | str) -> Column:
    return F.coalesce(col(c).startswith("http://") | col(c).startswith("https://"), F.lit(False))


def filename_from_url(c: Column | str) -> Column:
    path = F.split(col(c), r"\?", -1).getItem(0)
    return last_segment(F.rtrim(path, F.lit("/")), "/")


def filename_from_header(c: Column | str) -> Column:
    name = F.trim(strip(F.regexp_extract(col(c), FILENAME_HEADER, 1)), F.lit("\"'"))
    return F.nullif(name, F.lit(""))


def filename(url: Column | str, disposition: Column | str, content_type: Column | str) -> Column:
    """The header's name wins over the URL's; a name without a dot gets a suffix."""
    name = F.coalesce(filename_from_header(disposition), filename_from_url(url))
    kind = F.coalesce(col(content_type), F.lit(""))
    suffix = F.when(kind.contains("wordprocessingml") | kind.contains("docx"), ".docx").otherwise(".pdf")
    return F.when(last_segment(name, "/").contains("."), name).otherwise(F.concat(name, suffix))


def file_route(name: Column | str) -> Column:
    """Which reader takes a file, by extension."""
    extension = last_segment(F.lower(col(name)), r"\.")
    return (
        F.when(extension == "pdf", "pdf")
        .when(extension.isin("docx", "doc"), "docx")
        .otherwise("unsupported")
    )


def score_band(score: Column | str) -> Column:
    return F.when(col(score) >= 80, "success").when(col(score) >= 60, "warning").otherwise("error")


def needs_fallback(score: Column | str) -> Column:
    return col(score) < MIN_TEXT_QUALITY


def weights_problem(weights: Column | str) -> Column:
    """Null for usable weights (or none given), else what is wrong with them."""
    w = col(weights)
    keys = F.array_sort(F.map_keys(w))
    total = F.aggregate(F.map_values(w), F.lit(0.0), lambda s, x: s + x)
    wanted = F.array(*[F.lit(name) for name in sorted(DIMENSIONS)])
    return (
        F.when(w.isNull(), F.lit(None).cast("string"))
        .when(keys != wanted, "keys")
        .when(F.exists(F.map_values(w), lambda x: x.isNull() | ~x.between(0.0, 1.0)), "range")
        .when(F.abs(total - 1.0) > WEIGHT_SUM_TOLERANCE, "sum")
    )


def default_weights() -> Column:
    return F.create_map(*[F.lit(v) for pair in DEFAULT_WEIGHTS.items() for v in pair])


def weights_used(weights: Column | str) -> Column:
    return F.coalesce(col(weights), default_weights())


def scores_in_range(*scores: Column | str) -> Column:
    ok = F.lit(True)
    for score in scores:
        ok = ok & F.coalesce(col(score).between(0, 100), F.lit(False))
    return ok
