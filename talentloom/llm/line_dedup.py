"""Fuzzy line deduplication: one line is kept of every component of similar lines.

DataFrame operations only. Equal lines collapse first. The character shingles of each
distinct line are hashed; a MinHash signature is banded, lines that share a band are
candidates, and their full shingle sets decide. Union-find over the confirmed links
gives components, of which the earliest line (by document, then place) stays.

A signature is taken over all shingles of a line, so that it depends on nothing but the
set of shingles: lines with equal sets always meet, however often they repeat themselves.

Defined results: null text stays null; blank lines are never removed; lines shorter
than a shingle are only equal or different; a line is what stands between line feeds;
rows repeated with the same doc_id and text count as one document and are cleaned
alike; other columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import checked_broadcast, width
from talentloom.llm.links import WORDS, bitmap, linked_components, shared_postings
from talentloom.session import discard, materialise

SHINGLE = 12
PERCENT = 75
BANDS = 8
ROWS = 3


def _document(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _shingles(lines: DataFrame, *keep: str, size: int) -> DataFrame:
    """One row per shingle position of `line`: the columns to keep and its hash."""
    units = lines.select(*keep, F.encode("line", "UTF-16BE").alias("_units"))  # two bytes a character
    last = F.octet_length("_units") / 2 - size
    spread = units.where(last >= 0).select(*keep, "_units", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_at"))
    return spread.select(*keep, F.xxhash64(F.substring(F.col("_units"), 2 * F.col("_at") + 1, F.lit(2 * size))).alias("h"))


def _masks(n: int) -> list[int]:
    source = random.Random(9)
    return [source.getrandbits(64) - 2**63 for _ in range(n)]


def band_postings(lines: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, id) of every band of every line (doc, at, id, line), in `doc` partitions."""
    lows = [F.min(F.col("h").bitwiseXOR(F.lit(mask))).alias(f"m{i}") for i, mask in enumerate(_masks(bands * rows))]
    signs = _shingles(lines, "doc", "at", "id", size=size).groupBy("doc", "at", "id").agg(*lows)
    keys = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)])
    return signs.select(F.explode(keys).alias("key"), "id")


def outlines(lines: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, low, high, bits): the number of distinct shingles of each line (id, line), as both
    bounds, and their bitmap; lines shorter than a shingle have none. An id must not come twice."""
    items = lines.select("id", F.explode(_shingle_set("line", size)).alias("h"))
    each = items.groupBy("id").agg(F.count("*").alias("low"), *bitmap(F.col("h")))
    return each.select("id", "low", F.col("low").alias("high"), F.array(*[f"b{w}" for w in range(WORDS)]).alias("bits"))


def _shingle_set(line: str, size: int) -> Column:
    """The distinct shingle hashes of a line, as an array; the same hashes as _shingles has."""
    units = F.encode(line, "UTF-16BE")  # two bytes a character
    last = (F.octet_length(units) / 2 - size).cast("int")
    of = lambda held: F.transform(F.sequence(F.lit(0), held["last"]), lambda at: F.xxhash64(F.substring(held["units"], 2 * at + 1, F.lit(2 * size))))
    once = F.array(F.struct(units.alias("units"), last.alias("last")))  # held, so that a line is encoded once
    return F.array_distinct(F.when(last >= 0, F.transform(once, of)[0]).otherwise(F.array().cast("array<bigint>")))


def similar_lines(pairs: DataFrame, lines: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of the (a, b) pairs of line ids, those whose shingle sets have a Jaccard similarity of
    at least `percent` in a hundred. The lines move, not their shingles, whose sets are made
    and compared in the row of the pair."""
    pairs = materialise(pairs)
    one = pairs.join(lines.withColumnRenamed("id", "a"), "a").withColumnRenamed("line", "first")
    both = one.join(lines.withColumnRenamed("id", "b"), "b")
    sets = F.array(F.struct(_shingle_set("first", size).alias("x"), _shingle_set("line", size).alias("y")))
    counts = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("sizes")))
    near = F.exists(counts, lambda n: (n["sizes"] > 0) & (n["both"].cast("long") * (100 + percent) >= percent * n["sizes"].cast("long")))
    return both.where(near).select("a", "b")


def line_places(own: DataFrame) -> DataFrame:
    """(doc, doc_id, at, id) of every non-blank line of (doc, doc_id, text)."""
    lines = own.select("doc", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    full = lines.where(F.length(F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return full.select("doc", "doc_id", "at", F.xxhash64("line").alias("id"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, at): the lines that are not the earliest of their component, where `doc` is
    the hash of a document's id and text."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = source.select(_document(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id", "text")
    places = materialise(line_places(own))
    place = F.struct("doc_id", "doc", "at")
    firsts = places.groupBy("id").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    firsts = materialise(firsts.select("id", "place.*", "n"))

    # Of each distinct line one copy is read, in the document where it stands first.
    def read(texts: DataFrame, wanted: DataFrame) -> DataFrame:
        found = wanted.groupBy("doc").agg(F.collect_set("at").alias("places"))
        each = texts.join(found, "doc").select("doc", "places", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        return each.where(F.array_contains("places", F.col("at"))).select("doc", "at", F.xxhash64("line").alias("id"), "line")

    texts = own.select("doc", "text")
    postings = materialise(band_postings(read(texts, firsts), size).withColumn("rank", F.lit(0)))
    held = shared_postings(postings)
    met = materialise(held.select("id").distinct())
    among = materialise(firsts.join(checked_broadcast(met, 8), "id", "left_semi").select("id", "doc", "at"))
    discard(postings)
    near = checked_broadcast(materialise(among.select("doc").distinct()), 8)
    # Rows that come twice give their lines twice, but a bitmap wants every item once.
    lines = materialise(read(texts.join(near, "doc", "left_semi"), among).select("id", "line").dropDuplicates(["id"]), "zstd")

    def item_rows(active: DataFrame) -> DataFrame:
        held = lines.join(active, "id").repartition(width(lines), "id")  # dealt evenly, as a row gives many
        sets = held.select("id", "component", _shingle_set("line", size).alias("items"))
        return sets.select("id", "component", F.size("items").alias("size"), F.explode("items").alias("item"))

    outlined = materialise(outlines(lines, size))
    labels = linked_components(held, outlined, percent, lambda pairs: similar_lines(pairs, lines, size, percent), item_rows)

    # Only lines that stand more than once or have a link can be removed.
    linked = labels.withColumnRenamed("node", "id")
    named = firsts.join(linked, "id", "left").where("n > 1 OR component IS NOT NULL")
    named = materialise(named.withColumn("component", F.coalesce("component", "id")))
    stays = named.groupBy("component").agg(F.min(place).alias("place"))
    keeps = materialise(named.select("id", "component").join(stays, "component").select("id", F.col("place.doc").alias("_doc"), F.col("place.at").alias("_at")))
    met = places.join(checked_broadcast(keeps, 32), "id")
    return met.where("doc <> _doc OR at <> _at").select("doc", "at")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with the lines removed that repeat, exactly or nearly, an earlier line; the
    column n_removed is added."""
    gone = repeated_lines(docs, doc_id, text, size, percent).groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("at").alias("_gone"))
    gone = materialise(gone)
    kept = F.expr("array_join(filter(split(_text, '\n'), (line, i) -> NOT array_contains(_gone, i)), '\n')")
    cleaned = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept)
    own = docs.withColumn("_text", F.col(f"`{text}`")).withColumn("_doc", _document(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    columns = [cleaned.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return own.join(checked_broadcast(gone, 256), "_doc", "left").select(*columns, F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
