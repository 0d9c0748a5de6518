"""Fuzzy name matching: exact candidate generation, then one Arrow UDF.

Similarity is Ratcliff-Obershelp, 2M / (len a + len b). The matched characters
form a common subsequence, so a ratio of at least t means that a and b differ by
at most (1 - t) * (len a + len b) = d insertions and deletions. Cutting b into
d + 1 pieces leaves at least one piece untouched, at a known range of offsets
in a. Joining on (lengths, piece number, piece text) therefore finds every pair
that can qualify, with no pair of names ever compared for nothing but length.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.constants import FUZZY_THRESHOLD
from talentloom.session import salted_join

# The threshold as an exact percentage, for integer length bounds.
_PERCENT = round(FUZZY_THRESHOLD * 100)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp ratio of two strings, in Arrow batches."""

    # Nested, so that workers receive the function itself and need no install.
    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        values = [SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)]
        return pd.Series(values, dtype="float64")

    return F.pandas_udf(ratios, T.DoubleType())(a, b)


def _other_lengths(length: str) -> str:
    """Lengths m for which 2 * min(n, m) / (n + m) can reach the threshold."""
    low = f"cast(ceil({length} * {_PERCENT} / {200 - _PERCENT}) as int)"
    high = f"cast(floor({length} * {200 - _PERCENT} / {_PERCENT}) as int)"
    return f"sequence(greatest({low}, 1), greatest({high}, 1))"


def _edits(a: str, b: str) -> str:
    return f"cast(floor(({a} + {b}) * {100 - _PERCENT} / 100) as int)"


def _pieces(names: DataFrame) -> DataFrame:
    """Each name cut into pieces, once per length its partner may have."""
    start = "cast(floor(i * lb / (d + 1)) as int)"
    stop = "cast(floor((i + 1) * lb / (d + 1)) as int)"
    return (
        names.select(F.col("name").alias("b"), F.length("name").alias("lb"))
        .select("b", "lb", F.explode(F.expr(_other_lengths("lb"))).alias("la"))
        .withColumn("d", F.expr(_edits("la", "lb")))
        .select("b", "lb", "la", "d", F.expr("explode(sequence(0, d))").alias("i"))
        .select("b", "lb", "la", "i", F.expr(f"substring(b, {start} + 1, {stop} - {start})").alias("piece"))
    )


def _probes(names: DataFrame) -> DataFrame:
    """All substrings of a name that an untouched piece of a partner can equal."""
    start = "cast(floor(i * lb / (d + 1)) as int)"
    stop = "cast(floor((i + 1) * lb / (d + 1)) as int)"
    # Of d edits at most (d + lb - la) / 2 remove characters of b before the
    # piece, and at most (d - lb + la) / 2 insert some.
    first = "greatest(p - cast(floor((d + lb - la) / 2) as int), 0)"
    last = "least(p + cast(floor((d - lb + la) / 2) as int), la - w)"
    return (
        names.select(F.col("name").alias("a"), F.length("name").alias("la"))
        .select("a", "la", F.explode(F.expr(_other_lengths("la"))).alias("lb"))
        .withColumn("d", F.expr(_edits("la", "lb")))
        .select("*", F.expr("explode(sequence(0, d))").alias("i"))
        .select("*", F.expr(start).alias("p"), F.expr(f"{stop} - {start}").alias("w"))
        .withColumn("lo", F.expr(first))
        .withColumn("hi", F.expr(last))
        .filter("lo <= hi")
        .select("a", "la", "lb", "i", "w", F.expr("explode(sequence(lo, hi))").alias("at"))
        .select("a", "la", "lb", "i", F.expr("substring(a, at + 1, w)").alias("piece"))
        .distinct()
    )


def _shared_characters(a: str, b: str) -> str:
    """Size of the multiset overlap of two names: an upper bound of M."""
    return (
        f"aggregate(array_distinct(regexp_extract_all({a}, '(?s).', 0)), 0, (s, c) -> s + least("
        f"length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, ''))))"
    )


def candidate_pairs(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct (a, b) that may reach the threshold; a from names, b from tokens."""
    probes = _probes(names.filter(F.length("name") > 0).distinct())
    pieces = _pieces(tokens.filter(F.length("name") > 0).distinct())
    joined = salted_join(pieces, probes, ["la", "lb", "i", "piece"], ["b"])
    bound = F.expr(
        f"200 * {_shared_characters('a', 'b')} >= {_PERCENT} * (length(a) + length(b))"
    )
    return joined.select("a", "b").distinct().filter(bound)


def fuzzy_pairs(names: DataFrame, tokens: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(a, b, ratio) with ratio >= threshold, for a threshold not below the fixed one."""
    if threshold < FUZZY_THRESHOLD:
        raise ValueError("candidate generation covers thresholds from the fixed one upward")
    pairs = candidate_pairs(names, tokens)
    return pairs.withColumn("ratio", similarity("a", "b")).filter(F.col("ratio") >= threshold)


def best_fuzzy(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per name the most similar token; the smaller token on ties."""
    best = F.min_by(F.struct("b", "ratio"), F.struct(-F.col("ratio"), F.col("b")))
    return (
        fuzzy_pairs(names, tokens)
        .groupBy("a")
        .agg(best.alias("best"))
        .select("a", "best.b", "best.ratio")
    )
