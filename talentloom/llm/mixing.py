"""Mixing sources to target weights by temperature.

DataFrame operations only. A source's weight is its share of tokens to an exponent,
normalised. The exponent is bisected until the weights have a target entropy, or until
no source repeats more often than a limit. Each source's part of the token budget is
then laid out as whole permutations of its documents, one per repetition, the last one
a prefix; a document copy's place along that layout gives its block, so that every
block holds every source in its weight.

Permutations are orders of a hash. Running sums over a source are taken per hash range,
so a source with a large share of all rows is spread over many tasks.

Defined results: a document's tokens are its words and one end; null text has the end
alone; null sources form one source; rows equal in id, source and text are placed
together; extra columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.session import materialise

HIGHEST = 16.0  # above this exponent the largest source has practically all weight
LEVELS = 4  # levels of the bisection answered by one aggregate


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def _keyed(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """One row per distinct document, with the tokens of all its equal rows."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    slim = own.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("document"), token_count(F.col("text")).alias("n"))
    return slim.groupBy("doc_id", "source", "document").agg(F.sum("n").cast("long").alias("n_tokens"))


def _measures(sources: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy, highest repetition) of the weights under each exponent, in one job.
    Without a budget the largest source is read once."""
    top = math.log(sources.agg(F.max("tokens")).first()[0])
    found = []
    for exponent in exponents:
        log_w = F.lit(exponent) * (F.log("tokens") - top)
        w = F.exp(log_w)
        found += [F.sum(w), F.sum(w * log_w), F.max(w / F.col("tokens"))]
    row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(found)]).first()
    return [(math.log(z) - wl / z, most * budget / z if budget else most) for z, wl, most in zip(row[0::3], row[1::3], row[2::3], strict=True)]


def bisect_exponent(sources: DataFrame, budget: float | None, entropy: float | None = None, repetition: float | None = None, digits: int = 6) -> float:
    """The largest exponent whose weights still have this entropy, or the smallest up to
    one under which no source repeats more often than the limit; rounded to `digits`."""
    low, high = 0.0, HIGHEST if repetition is None else 1.0

    def above(measures: tuple[float, float]) -> bool:
        return measures[0] >= entropy if repetition is None else measures[1] > repetition

    while high - low > 10.0 ** -(digits + 3):
        points = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS)]
        measured = dict(zip(points, _measures(sources, points, budget), strict=True))
        for _ in range(LEVELS):
            middle = min(points, key=lambda x: abs(x - (low + high) / 2))
            low, high = (middle, high) if above(measured[middle]) else (low, middle)
    return round((low + high) / 2, digits)


def mix(
    docs: DataFrame,
    entropy_share: float | None = None,
    repetition: float | None = None,
    budget: int | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 1,
    range_docs: int = 1000,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(doc_id, source, document, copy, n_tokens, block, order_key): which documents the
    mixture holds, how often, and where; inside a block copies are read by order_key.

    `entropy_share` is the target entropy as a share of that of equal weights;
    `repetition` the highest number of times a source may be read. `budget` is the number
    of tokens of the mixture, all tokens of `docs` by default. With a repetition limit
    and no budget, the budget is the least that holds every document once.
    """
    slim = materialise(_keyed(docs, doc_id, source, text))
    sources = materialise(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    total, largest, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.count("*")).first()
    whole = repetition is not None and budget is None
    budget = total if budget is None else budget
    if not n:
        exponent = 1.0
    elif whole:
        # Read against the largest source, which is read once.
        exponent = bisect_exponent(_relative(sources, largest), None, repetition=repetition)
    else:
        target = None if entropy_share is None else entropy_share * math.log(n)
        exponent = bisect_exponent(sources, budget, target, repetition)
    scaled = F.exp(F.lit(exponent) * (F.log("tokens") - math.log(largest or 1)))
    norm = 1.0 if not n else largest if whole else budget / sources.agg(F.sum(scaled)).first()[0]
    parts = sources.select(
        F.col("source").alias("_source"),
        "tokens",
        F.greatest(F.round(scaled * norm).cast("long"), F.when(F.lit(whole), F.col("tokens")).otherwise(F.lit(1))).alias("part"),
        (F.floor(F.col("docs") / range_docs) + 1).alias("ranges"),
    )
    copies = F.explode(F.sequence(F.lit(0), F.floor((F.col("part") - 1) / F.col("tokens")).cast("int"))).alias("copy")
    laid = slim.join(parts, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "document", "n_tokens", "tokens", "part", "ranges", copies
    )
    order_key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    laid = laid.withColumn("order_key", order_key)
    laid = laid.withColumn("range", F.floor(F.conv(F.substring("order_key", 1, 6), 16, 10).cast("long") * F.col("ranges") / 2**24))
    group = ["source", "copy"]
    sums = laid.groupBy(*group, "range").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("copy").alias("_c"), F.col("range").alias("_r"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "range").orderBy("order_key", "n_tokens", "document").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    same = laid["source"].eqNullSafe(sums["_s"]) & (laid["copy"] == sums["_c"]) & (laid["range"] == sums["_r"])
    at = F.col("copy") * F.col("tokens") + F.col("_before") + F.col("_inside")
    blocks = max(1, -(-budget // block_tokens)) if n else 1
    placed = laid.join(sums, same).withColumn("at", at).where(F.col("at") + F.col("n_tokens") <= F.col("part"))
    each = F.ceil(F.col("part") / blocks)
    return placed.select("doc_id", "source", "document", "copy", "n_tokens", F.floor(F.col("at") / each).alias("block"), "order_key")


def _relative(sources: DataFrame, largest: int) -> DataFrame:
    return sources.withColumn("tokens", F.col("tokens") / F.lit(largest))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, unchanged, each as often as the mixture holds it."""
    chosen = mix(docs, doc_id=doc_id, source=source, text=text, **options).select(F.col("document").alias("_document"))
    keyed = docs.withColumn("_document", F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`")))
    return keyed.join(chosen, "_document").select(*[F.col(f"`{c}`") for c in docs.columns])
