"""Near-duplicate documents through an inverted join on signature coordinates.

A document's set is its distinct five-word shingles (all words as one shingle if there
are fewer). Documents with equal sets form a class; one MinHash signature stands for
each class. Classes are posted under each (coordinate, value) pair. Two sets at the
similarity bound agree in about 75 of 100 coordinates, so a pair must agree in at least
`least` of them: values that no other class has cannot count, a class with too few
shared values is skipped whole, and each other class is posted only under its rarest
values (a prefix), of which any qualifying pair shares one. Pairs that meet are kept if
they agree in `least` coordinates and are then confirmed on their full sets.

Defined results: lower case means A-Z only; null or wordless text has an empty set, is
linked with nothing and kept; repeated rows have the same component and, as they carry
the same doc_id, the same `kept`; rows without a doc_id join their class and are not
kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import checked_broadcast, lower_words, own_columns, per_row, utf8, width
from talentloom.llm.links import WORDS, linked_components, shared_postings, similar_pairs
from talentloom.session import materialise

COORDINATES = 64
LEAST = 34  # of 64: a pair at 0.75 falls below with probability about 1e-5
PERCENT = 75
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int = 5, remember: int = 300_000):
        self.size, self.remember, self.known = size, remember, {}

    def word(self, w: bytes) -> int:
        h = self.known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[w] = h
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        ws = lower_words(utf8(text))
        h = np.fromiter(map(self.word, ws), np.uint64, len(ws))
        span = min(self.size, len(h))
        if not span:
            return h
        acc = np.full(len(h) - span + 1, span, np.uint64)
        for j in range(span):
            acc = mixed(acc * _MIX + h[j : len(h) - span + 1 + j])
        return np.unique(acc)


def signature(items: np.ndarray, factors: np.ndarray, block: int = 2048) -> np.ndarray:
    """For each factor the smallest product with an item; the place is mixed in, so that
    equal values of different coordinates stay different."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), block):
        np.minimum(low, (items[i : i + block, None] * factors).min(axis=0), out=low)
    return mixed(low + np.arange(1, len(factors) + 1, dtype=np.uint64) * _STEP)


def factors(n: int = COORDINATES) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed(docs: DataFrame, size: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, high, low, keys): a 128-bit hash of the set and its signature."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def start():
        shingler, own = Shingler(size), factors(coordinates)

        def handle(key, text):
            items = shingler.shingles(text)
            if not len(items):
                return key, 0, None, None, None
            high, low = np.frombuffer(xxhash.xxh128_digest(items.tobytes()), np.int64)
            return key, len(items), int(high), int(low), signature(items, own).view(np.int64)

        return handle

    return docs.mapInArrow(per_row(start, schema), "doc_id long, n_shingles long, high long, low long, keys array<long>")


def item_sets(docs: DataFrame, size: int = 5, words: int = WORDS) -> DataFrame:
    """(id, items, bits): the full shingle set of each document and its parity bitmap."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("items", longs), ("bits", longs)])

    def start():
        shingler = Shingler(size)

        def handle(key, text):
            items, bits = shingler.shingles(text), np.zeros(words, np.uint64)
            np.bitwise_xor.at(bits, ((items >> np.uint64(6)) & np.uint64(words - 1)).astype(int), np.uint64(1) << (items & np.uint64(63)))
            return key, items.view(np.int64), bits.view(np.int64)

        return handle

    return docs.mapInArrow(per_row(start, schema, flush=500), "id long, items array<long>, bits array<long>")


def prefix_postings(classes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """(key, id, rank): each class under the rarest of its values that others have too;
    a class that shares more of its values ranks lower, as more central."""
    posted = classes.select("id", F.explode("keys").alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(counts, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("values"))
    # Values of its own take the first places of a prefix of coordinates - least + 1.
    places = F.size("values") - least + 1
    rank = -F.size("values")
    return shared.where(places > 0).select("id", rank.alias("rank"), F.explode(F.slice("values", 1, places)).alias("value")).select("value.key", "id", "rank")


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    size: int = 5,
    coordinates: int = COORDINATES,
    least: int = LEAST,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`."""
    own = own_columns(docs, doc_id=doc_id, text=text)
    base = materialise(signed(own, size, coordinates))
    slim = base.select("doc_id", "n_shingles", "high", "low")
    classes = materialise(slim.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("class")))
    named = classes.where("class IS NOT NULL").select(F.col("class").alias("doc_id"), "high", "low")
    signs = materialise(base.join(named, ["doc_id", "high", "low"]).select(F.col("doc_id").alias("id"), "keys", "high", "low").dropDuplicates(["id", "high", "low"]))
    held = shared_postings(prefix_postings(signs, coordinates, least))

    met = materialise(held.select("id").distinct())
    wanted = checked_broadcast(met.select(F.col("id").alias("doc_id")), 8)
    sets = materialise(item_sets(own.join(wanted, "doc_id", "left_semi"), size).dropDuplicates(["id"]).withColumn("size", F.size("items")))

    def agree(pairs: DataFrame) -> DataFrame:
        one = signs.select(F.col("id").alias("a"), F.col("keys").alias("x"))
        other = signs.select(F.col("id").alias("b"), F.col("keys").alias("y"))
        return pairs.join(one, "a").join(other, "b").where(F.size(F.array_intersect("x", "y")) >= least).select("a", "b")

    def item_rows(active: DataFrame) -> DataFrame:
        held = sets.join(active, "id").repartition(width(sets), "id")  # dealt evenly, as a row gives many
        return held.select("id", "component", "size", F.explode("items").alias("item"))

    outlined = sets.select("id", F.col("size").alias("low"), F.col("size").alias("high"), "bits")
    labels = linked_components(held, outlined, percent, lambda pairs: similar_pairs(agree(pairs), sets, percent), item_rows)
    # By set: the smallest document of the component; a class is named by its smallest.
    found = labels.select(F.col("node").alias("class"), "component")
    whole = classes.join(found, "class", "left").select("high", "low", F.coalesce("component", "class").alias("component"))
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        slim.join(whole, ["high", "low"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_shingles") == 0))
    )
