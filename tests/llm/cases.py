"""Awkward documents: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size int, line string, component long, n int, doc long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    source = random.Random(seed)
    out = []
    for i in range(words):
        out.append("".join(source.choice(["ba", "re", "ti", "on", "mu", "el", "sha", "ko"]) for _ in range(1 + source.randrange(vocabulary) % 4)))
        if i % 25 == 24:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def edited(text: str, seed: int, every: int) -> str:
    """A near copy: about one word in `every` replaced."""
    source = random.Random(seed)
    return "\n".join(" ".join("qx%d" % source.randrange(999) if source.randrange(every) == 0 else w for w in line.split(" ")) for line in text.split("\n"))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 300)
    rows: list[tuple[int | None, str | None]] = [(1, base), (2, base), (2, base), (3, edited(base, 5, 120)), (4, edited(base, 6, 4))]
    rows += [(10 + i, edited(base, 20 + i, 40)) for i in range(12)]
    rows += [(30 + i, prose(50 + i, 120)) for i in range(6)]
    rows += [(50, None), (51, ""), (52, " \t\n \x0b"), (53, "one two"), (54, "One  TWO"), (55, "Ä ä"), (None, base), (None, None)]
    rows += [(60, prose(99, 30_000)), (61, "x" * 50_000), (62, "same same same " * 500), (63, "# $ % & " * 100), (64, "LOUD TALK HERE! " * 5 + prose(7, 60).upper())]
    return rows


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    full = [(i, t, "en", None if n % 7 == 0 else f"src{n % 3 * (n % 2)}", len(t or ""), 5, "k", 1, "l", 9, 3, 4) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
