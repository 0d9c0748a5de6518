"""Links between sets that share keys, and the components they form.

DataFrame operations only. A key's members are never paired with each other all at
once: each is first compared with one hub of the key, its most central member. What
these links join needs no further comparison. Where a key still holds several
components, the pairs across them that exact bounds leave are compared at last, so
that no link between components is lost. Bounds come from outlines of the sets, which are
small; what decides, the sets or their texts, moves only for pairs that they leave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import checked_broadcast
from talentloom.session import materialise

WORDS = 16  # longs of a bitmap


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of (a, b) edges.

    Distributed union-find by contraction: every node hooks to its smallest smaller
    neighbour, chains are halved until all point to roots, and the edges between roots
    go into the next round. Each step is written, so lineage stays short.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    left = materialise(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    )
    while not left.isEmpty():
        roots = materialise(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = materialise(roots.join(above, "root", "left").select("node", "root", "higher"))
            if jumped.where("higher IS NOT NULL").isEmpty():
                break
            roots = jumped.select("node", F.coalesce("higher", "root").alias("root"))
        mine = roots.select(F.col("node").alias("component"), "root")
        labels = materialise(labels.join(mine, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        low = roots.select(F.col("node").alias("lo"), F.col("root").alias("lo_root"))
        high = roots.select(F.col("node").alias("hi"), F.col("root").alias("hi_root"))
        ends = left.join(low, "lo", "left").join(high, "hi").select(F.coalesce("lo_root", "lo").alias("a"), F.col("hi_root").alias("b"))
        left = materialise(ends.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    return labels


def bitmap(item: Column, words: int = WORDS) -> list[Column]:
    """Aggregates b0, b1, ...: a parity bitmap of the distinct items of a group, in longs. Each
    item turns its bit over, so that of two groups only what one of them has alone shows, however
    full the bitmaps are. An item must not come twice."""
    word, bit = F.shiftrightunsigned(item, 6).bitwiseAND(F.lit(words - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), item.bitwiseAND(F.lit(63)).cast("int"))
    return [F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0))).alias(f"b{w}") for w in range(words)]


def distance(one: str = "_a", other: str = "_b", words: int = WORDS) -> Column:
    """A lower bound of the items that only one of two sets has, as a share of their sizes:
    items that both have turn over the same bits in both, so each bit that differs in their
    parity bitmaps stands for one that they do not share, at least."""
    apart = sum(F.bit_count(F.col(f"bits{one}")[w].bitwiseXOR(F.col(f"bits{other}")[w])) for w in range(words))
    return apart / (F.col(f"high{one}") + F.col(f"high{other}"))


def possible(percent: int, one: str = "_a", other: str = "_b", words: int = WORDS) -> Column:
    """Whether two sets can have a Jaccard similarity of `percent` in a hundred, from bounds
    low and high of their sizes and from their bitmaps. Never false for a pair that reaches
    it: the margin is far above the rounding of the quotient."""
    low, high = (lambda side: F.col(f"low{side}")), (lambda side: F.col(f"high{side}"))
    sizes = (high(one) * 100 >= low(other) * percent) & (high(other) * 100 >= low(one) * percent)
    return sizes & (distance(one, other, words) <= (100 - percent) / (100 + percent) + 1e-9)


def sided(outlines: DataFrame, side: str) -> DataFrame:
    return outlines.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("low", "high", "bits")])


def possible_pairs(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that the outlines (id, low, high, bits) of their sets do not exclude,
    with the distance these show."""
    met = pairs.join(sided(outlines, "a"), "a").join(sided(outlines, "b"), "b")
    return met.where(possible(percent)).select("a", "b", distance().alias("distance"))


def nearest(pairs: DataFrame) -> DataFrame:
    """Of (a, b, distance) pairs, the nearest one of every end."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end"), "distance", "a", "b")
    return ends.groupBy("end").agg(F.min(F.struct("distance", "a", "b")).alias("pair")).select("pair.a", "pair.b").distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the (a, b) pairs, those whose sets (id, size, items) have a Jaccard similarity
    of at least `percent` in a hundred, exactly."""
    pairs = materialise(pairs)
    needed = checked_broadcast(materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), 8)
    used = sets.select("id", "size", "items").join(needed, "id", "left_semi")
    one = used.select(F.col("id").alias("a"), F.col("items").alias("x"), F.col("size").alias("n"))
    other = used.select(F.col("id").alias("b"), F.col("items").alias("y"), F.col("size").alias("m"))
    both = F.size(F.array_intersect("x", "y"))
    sized = pairs.join(one, "a").join(other, "b").select("a", "b", "n", "m", both.alias("both"))
    return sized.where(F.col("both") * (100 + percent) >= percent * (F.col("n") + F.col("m"))).select("a", "b")


def shared_items(rows: DataFrame) -> DataFrame:
    """Of item rows (id, ..., item), those of items that n > 1 sets have, with n and the
    size of the set, which is counted if the rows do not bring it."""
    rows = materialise(rows)
    counts = rows.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(counts, "item")
    if "size" not in rows.columns:
        shared = shared.join(rows.groupBy("id").agg(F.count("*").alias("size")), "id")
    return materialise(shared)


def rarest_items(items: DataFrame, percent: int) -> DataFrame:
    """Of shared item rows, those that can be the rarest common item of a set with another
    that is similar by `percent` in a hundred: so many of its shared items must be common
    that the rarest of them cannot come later."""
    mine = Window.partitionBy("id")
    ranked = items.withColumn("_at", F.row_number().over(mine.orderBy("n", "item"))).withColumn("_held", F.count("*").over(mine))
    return ranked.where((F.col("_held") - F.col("_at") + 1) * 100 >= F.col("size") * percent).drop("_at", "_held")


def shared_postings(postings: DataFrame) -> DataFrame:
    """(key, id, hub, n): the postings (key, id, rank) of keys with several members, the
    lowest-ranked of which is the hub. Written, as most keys have one member only."""
    counts = materialise(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialise(postings.join(checked_broadcast(counts, 16), "key"))
    hubs = shared.groupBy("key").agg(F.min(F.struct("rank", "id")).getField("id").alias("hub"))
    return materialise(shared.join(hubs, "key").select("key", "id", "hub", "n"))


def linked_components(
    held: DataFrame,
    outlines: DataFrame,
    percent: int,
    confirm: Callable[[DataFrame], DataFrame],
    item_rows: Callable[[DataFrame], DataFrame],
    large: int = 64,
) -> DataFrame:
    """(node, component) under all links between sets that share a key of `held`, made by
    shared_postings. Ids without a link are left out.

    `outlines` (id, low, high, bits) bound the sizes of the sets and hold their bitmaps; ids
    without one have no links. `confirm` keeps the links of (a, b) pairs that the outlines
    leave, exactly; `item_rows` makes a row per distinct item of rows (id, component), and may add
    the size of the set. Pairs inside a component are not tried. Keys with the same members count once. Up to `large`
    members, a key's pairs across components are taken if the outlines leave them, the nearest
    ones first. Above, a
    link either has an item that at most `large` sets share, by the rarest of which it is
    found, or its intersection consists of more frequent items, whose number bounds it. No way misses a
    link.
    """
    stars = materialise(held.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("keys")))
    best = stars.groupBy("b").agg(F.max(F.struct("keys", "a")).getField("a").alias("a"))

    def tested(pairs: DataFrame) -> DataFrame:
        return materialise(confirm(possible_pairs(pairs, outlines, percent).select("a", "b")))

    links = tested(best.select("a", "b"))
    labels = components(links)
    ends = with_component(with_component(stars, labels, "a", "ca"), labels, "b", "cb")
    more = tested(ends.where("ca <> cb").join(best, ["a", "b"], "left_anti").select("a", "b"))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)

    # Pairs with the hub have been tried; what is left needs two others, in two components.
    rest = held.where("n > 2 AND id <> hub").select("key", "id", "n")
    active = materialise(with_component(rest, labels, "id", "component"))
    members = [F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x")]
    several = active.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("k"), *members)
    keys = several.where("c0 < c1").groupBy("k", "s", "x").agg(F.min("key").alias("key")).select("key")
    active = materialise(active.join(materialise(keys), "key", "left_semi"))
    outlined = materialise(outlines.join(materialise(active.select("id").distinct()), "id", "left_semi"))
    small = active.where(F.col("n") <= large).select("key", "id", "component")
    big = active.where(F.col("n") > large)
    found = None
    if not big.isEmpty():
        placed = materialise(big.select("id", "component").distinct())
        items = shared_items(item_rows(placed))
        own = materialise(rarest_items(items, percent).where(F.col("n") <= large))
        one = own.select("item", F.col("id").alias("a"), F.col("component").alias("ca"))
        other = own.select("item", F.col("id").alias("b"), F.col("component").alias("cb"))
        found = one.join(other, "item").where("ca < cb").select("a", "b").distinct()
        frequent = items.where(F.col("n") > large).groupBy("id").agg(F.count("*").alias("common"))
        sized = big.join(materialise(frequent.join(outlined.select("id", "low"), "id")), "id")
        least = sized.groupBy("key").agg(F.min("low").alias("least"))
        left = sized.join(least, "key").where(f"common * {100 + percent} >= {percent} * (low + least)")
        small = small.unionByName(left.select("key", "id", "component"))
    alive = materialise(small.join(outlined, "id"))
    one, other = (alive.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "low", "high", "bits")]) for side in ("a", "b"))
    met = one.join(other, (one["key"] == other["key"]) & (F.col("component_a") < F.col("component_b")) & possible(percent))
    pairs = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), distance().alias("distance"))
    if found is not None:
        pairs = pairs.unionByName(possible_pairs(found, outlined, percent))
    pairs = materialise(pairs.distinct())
    # What the nearest pairs connect leaves few of the others across components.
    for turn in range(3):
        if pairs.isEmpty():
            break
        picked = pairs.select("a", "b") if turn == 2 else materialise(nearest(pairs))
        more = materialise(confirm(picked))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        if turn < 2:
            ends = with_component(with_component(pairs.join(picked, ["a", "b"], "left_anti"), labels, "a", "ca"), labels, "b", "cb")
            pairs = materialise(ends.where("ca <> cb").select("a", "b", "distance"))
    return labels


def with_component(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """The component of a column's ids; an id without links is its own."""
    found = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))
