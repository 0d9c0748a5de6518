"""Merkle manifest of a dataset, with inclusion proofs by pointer jumping.

A row's leaf is the SHA-256 of its encoded columns. The leaves of a partition (here: a
language) form a tree of degree eight in the order of their ids; the roots of the
partitions form another one, whose root stands for the whole dataset.

Proofs do not walk the tree level by level. Every node starts with a segment: its
siblings to the left and to the right, which is its part of a proof towards its parent.
A self-join appends to the segment of a node the segment of the node it points to, and
makes it point where that one points; so each round doubles the distance, and after a
logarithmic number of rounds every segment reaches the root. Rounds run over inner nodes
only, an eighth of the leaves; runs of eight leaves meet the segment of their parent at
last, and each leaf folds its own siblings and that segment into its proof.

Group sizes: a run has at most eight nodes. Places of leaves come from range totals, so
one language may hold most rows. In the round that doubles a distance of d levels, at most
8**d nodes point to one; the pointed-to side is broadcast only when a count shows that it
is small, which it is where 8**d is large.

Defined results: null columns are encoded as `-`, so a null differs from an empty text;
rows of equal id come in the order of their leaves, those without an id first; equal rows
are leaves of their own; rows without a partition value are a partition, the first; an
empty table has no rows; other columns than the named ones are not read, whatever their
names. Long texts are hashed where they are read and never move.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import checked_broadcast, own_columns
from talentloom.operators.ranking import numbered
from talentloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DEGREE = 8


def encoded(value: Column) -> Column:
    """`-` for a null; else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def leaf(fields: list[Column]) -> Column:
    return digest(*[encoded(f) for f in fields])


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """(key, part, leaf, tampered): digests of every row, as it is and with its text in lower
    case where 3 divides the CRC of its key; `tampered` is null for the other rows."""
    own = own_columns(docs, **{f"f{i}": f for i, f in enumerate(fields)})
    columns = [F.col(f"f{i}") for i in range(len(fields))]
    at = {name: F.col(f"f{i}") for i, name in enumerate(fields)}
    changed = [lowered(c) if name == text else c for name, c in zip(fields, columns, strict=True)]
    chosen = F.crc32(at[key].cast("string").cast("binary")) % 3 == 0
    return own.select(
        at[key].alias("key"), at[part].alias("part"), leaf(columns).alias("leaf"), F.when(chosen, leaf(changed)).alias("tampered")
    )


@dataclass
class Tree:
    """The nodes of all trees, written.

    runs      part, run, members (key, leaf, tampered), node: lowest level, at most eight leaves each
    segments  node, left, right: siblings of every node that a run of leaves hangs from, up to the root
    lone      part, key, leaf, tampered, node: the leaves of partitions with one leaf
    root      the root's digest, one row
    """

    runs: DataFrame
    segments: DataFrame
    lone: DataFrame
    root: DataFrame


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of eight neighbours: (tree, place, digest, members) one level higher."""
    return (
        nodes.groupBy("tree", F.floor(F.col("place") / DEGREE).alias("place"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("members"))
        .withColumn("digest", digest(F.array_join(F.col("members.digest"), "")))
    )


def _links(level: DataFrame, number: int, parents: int) -> DataFrame:
    """One row per node of the runs of `level`: its name, its parent's, and its siblings."""
    each = level.select("tree", F.col("place").alias("above"), "members", F.posexplode("members").alias("i", "member"))
    digests = F.col("members.digest")
    return each.select(
        node_name(F.lit(number), "tree", F.col("member.place")).alias("node"),
        node_name(F.lit(parents), "tree", "above").alias("to"),
        F.array(F.array_join(F.slice(digests, F.lit(1), F.col("i")), "")).alias("left"),
        F.array(F.array_join(F.slice(digests, F.col("i") + 2, F.lit(DEGREE)), "")).alias("right"),
    )


def node_name(level: Column, tree: Column | str, place: Column | str) -> Column:
    return F.struct(level.cast("int").alias("level"), F.col(tree).alias("tree") if isinstance(tree, str) else tree.alias("tree"),
                    (F.col(place) if isinstance(place, str) else place).cast("bigint").alias("place"))


def jumped(links: DataFrame) -> DataFrame:
    """(node, left, right) with the segments of all levels up to the root.

    `links` holds (node, to, left, right) for every node but the root. A pointer at the
    root has arrived and is null, so arrived nodes, in the end all of them, meet in no join.
    """
    known = links.select(F.col("node").alias("to"), F.col("node").alias("known"))
    links = materialise(links.join(known, "to", "left").select("node", F.col("known").alias("to"), "left", "right"))
    arrived, going = [], links
    while True:
        arrived.append(going.where("to IS NULL").select("node", "left", "right"))
        going = going.where("to IS NOT NULL")
        if going.isEmpty():
            break
        aim = materialise(going.select("to").distinct())
        beyond = links.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("left").alias("l"), F.col("right").alias("r"))
        pointed = materialise(beyond.join(checked_broadcast(aim, 32), "to", "left_semi"))
        going = materialise(
            going.join(checked_broadcast(pointed, 2048), "to").select(
                "node", F.col("next").alias("to"), F.concat("left", "l").alias("left"), F.concat("right", "r").alias("right")
            )
        )
        # The other half of the self-join: what has arrived can be pointed to as well.
        links = reduce(DataFrame.unionByName, [*(a.withColumn("to", F.lit(None).cast(links.schema["to"].dataType)) for a in arrived), going])
    return reduce(DataFrame.unionByName, arrived)


def build(hashed: DataFrame) -> Tree:
    """The trees over (key, part, leaf, tampered) rows.

    Trees are numbered: 0 is the tree of partition roots, the others follow their order.
    """
    rows = materialise(hashed)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    # Spark orders strings by their UTF-8 bytes, nulls first.
    trees = materialise(numbered(sizes, [], [F.asc_nulls_first("part")], "tree"))
    order = [F.asc_nulls_first("key"), F.asc("leaf"), F.asc("tampered")]
    placed = numbered(rows, ["part"], order, "place").withColumn("place", F.col("place") - 1)
    named = placed.join(checked_broadcast(trees, 64), placed["part"].eqNullSafe(trees["part"])).select(
        placed["part"], "tree", "place", "key", "leaf", "tampered", "n"
    )
    lone = materialise(named.where("n = 1").select("part", "tree", "key", "leaf", "tampered"))
    runs = materialise(
        named.where("n > 1")
        .groupBy("part", "tree", F.floor(F.col("place") / DEGREE).alias("place"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "key", "leaf", "tampered"))).alias("members"))
        .withColumn("digest", digest(F.array_join(F.col("members.leaf"), "")))
    )
    # Levels 1, 2, ...: a tree ends when it has one node, its subroot.
    links, tops, number = None, lone.select("tree", F.lit(0).alias("level"), F.col("leaf").alias("digest")), 1
    level, most = runs.select("tree", "place", "digest"), (trees.agg(F.max("n")).first()[0] or 0)

    def added(more: DataFrame) -> DataFrame:
        return more if links is None else links.unionByName(more)

    widest = -(-most // DEGREE)
    while widest:
        last = trees.select("tree", F.col("n").alias("leaves")).where(f"leaves > 1 AND ceil(leaves / {DEGREE**number}D) = 1")
        tops = tops.unionByName(
            level.join(last.where(f"ceil(leaves / {DEGREE ** (number - 1)}D) > 1"), "tree").select("tree", F.lit(number).alias("level"), "digest")
        )
        if widest == 1:
            break
        above = materialise(_runs(level.join(last.select("tree"), "tree", "left_anti")))
        links = added(_links(above, number, number + 1))
        level, number, widest = above.select("tree", "place", "digest"), number + 1, -(-widest // DEGREE)
    # The tree of subroots: its nodes of level 0 are the tops of the others.
    subroots = materialise(tops)
    above = subroots.select(F.lit(0).cast("bigint").alias("tree"), (F.col("tree") - 1).alias("place"), "digest")
    count, number = trees.count(), 0
    while count > 1:
        runs_above = materialise(_runs(above))
        found = _links(runs_above, number, number + 1)
        if number == 0:  # a subroot is known by its own tree
            own = subroots.select((F.col("tree") - 1).alias("place"), node_name(F.col("level"), "tree", F.lit(0)).alias("own"))
            found = found.join(own, found["node.place"] == own["place"]).select(F.col("own").alias("node"), "to", "left", "right")
        links = added(found)
        above, number, count = runs_above.select("tree", "place", "digest"), number + 1, -(-count // DEGREE)
    if links is None:
        empty = node_name(F.lit(0), F.lit(0).cast("bigint"), F.lit(0))
        none = F.array().cast("array<string>")
        links = rows.limit(0).select(empty.alias("node"), empty.alias("to"), none.alias("left"), none.alias("right"))
    segments = materialise(jumped(materialise(links)))
    subroot = subroots.select("tree", F.col("digest").alias("subroot"))
    known = checked_broadcast(materialise(subroot), 96)
    named_runs = runs.select("tree", "part", node_name(F.lit(1), "tree", "place").alias("node"), "members").join(known, "tree")
    named_lone = lone.withColumn("node", node_name(F.lit(0), "tree", F.lit(0))).join(known, "tree")
    return Tree(named_runs, segments, named_lone, materialise(above.select(F.col("digest").alias("root"))))


def folded(start: Column, left: Column, right: Column) -> Column:
    """The root above `start` by its siblings, level by level."""
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), start, lambda at, s: digest(s["left"], at, s["right"]))


def siblings(left: Column, right: Column) -> Column:
    """All siblings of a proof as one text: level by level, left to right."""
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")


def proofs(tree: Tree) -> DataFrame:
    """(key, part, leaf, tampered, subroot, root, left, right) for every leaf: its full proof."""
    in_runs = tree.runs.join(tree.segments, "node", "left")
    digests = F.col("members.leaf")
    own = F.transform(
        "members",
        lambda m, i: F.struct(
            m["key"].alias("key"), m["leaf"].alias("leaf"), m["tampered"].alias("tampered"),
            F.array_join(F.slice(digests, F.lit(1), i), "").alias("l"), F.array_join(F.slice(digests, i + 2, F.lit(DEGREE)), "").alias("r"),
        ),
    )
    none = F.array().cast("array<string>")
    up = [F.coalesce(c, none).alias(c) for c in ("left", "right")]
    each = in_runs.select("part", "subroot", *up, F.explode(own).alias("m")).select(
        "m.key", "part", "m.leaf", "m.tampered", "subroot",
        F.concat(F.array("m.l"), "left").alias("left"), F.concat(F.array("m.r"), "right").alias("right"),
    )
    alone = tree.lone.join(tree.segments, "node", "left").select("key", "part", "leaf", "tampered", "subroot", *up)
    return each.unionByName(alone).join(F.broadcast(tree.root))  # one row


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per document."""
    found = proofs(build(leaves(docs)))
    root = folded(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right"))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root",
        digest(siblings(F.col("left"), F.col("right"))).alias("proof_sha256"), root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
