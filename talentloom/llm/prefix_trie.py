"""Prefix trie of conversations that share their beginnings, by composable fingerprints.

A sequence of turns has a fingerprint in a monoid: (value, shift) pairs modulo a prime of
127 bits, where joining two sequences joins their pairs, and where a prefix can be taken
off the front again. So the fingerprint of a rebuilt conversation up to any depth is the
product of its base's head and a stretch of its own turns, both known from the stored
conversations; no rebuilt text is ever made.

Turns are sorted by range into bounded stretches, each with the product of what comes
before it in its range; ranges of one conversation are chained by at most one row per
range. So a conversation of any length is read by many tasks. Rebuilt conversations with
the same fingerprint at the same depth form a node. That they are equal is then verified:
every row keeps a reference to its last turn (conversation, place, SHA-256 of role and
text), and all rows of a node must refer to equal turns and hang from one parent. By
induction the whole prefixes are equal. If any node fails, all is done again with another
multiplier.

Sums over subtrees need no walk down the trie: each node, and each childless node, belongs
to its smallest conversation, which passes through all nodes above; so a node's sums are
sums over its members of what belongs to them, and a running sum along its own
conversation for the rest. Nodes with very many members are only ever aggregated, with
partial sums, or met by salted joins. Hashes over many member ids are fed from pieces of
a sorted range, so no list of members is ever held.

Defined results: turns are ordered by turn (null first), role and hash of the text; null
role or text is empty; repeated rows are turns of their own; rows without conv_id belong
to no conversation and are left out; a base that has no turns gives no head; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import own_columns, to_batch, width
from talentloom.operators.ranking import running
from talentloom.session import materialise, salted_join

PRIME = 2**127 - 1
HEAD = 8  # the longest head: a remainder of division by nine


class Fingerprints:
    """The monoid. An element is (value, shift); shift is the multiplier to the power of the length."""

    def __init__(self, seed: int = 0):
        self.multiplier = int.from_bytes(hashlib.sha256(b"multiplier %d" % seed).digest(), "big") % PRIME
        self.inverse = pow(self.multiplier, -1, PRIME)

    EMPTY = (0, 1)

    def of(self, turn: bytes) -> tuple[int, int]:
        return int.from_bytes(turn, "big") % PRIME, self.multiplier

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        return (a[0] + a[1] * b[0]) % PRIME, a[1] * b[1] % PRIME

    def without(self, whole: tuple[int, int], head: tuple[int, int], length: int) -> tuple[int, int]:
        """What follows `head`, a prefix of `whole` with `length` turns."""
        back = pow(self.inverse, length, PRIME)
        return (whole[0] - head[0]) * back % PRIME, whole[1] * back % PRIME

    def product(self, turns: list[bytes]) -> tuple[int, int]:
        total = self.EMPTY
        for turn in turns:
            total = self.join(total, self.of(turn))
        return total


def written(element: tuple[int, int]) -> bytes:
    return element[0].to_bytes(16, "big") + element[1].to_bytes(16, "big")


def read(raw: bytes) -> tuple[int, int]:
    return int.from_bytes(raw[:16], "big"), int.from_bytes(raw[16:], "big")


def head_length(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % (HEAD + 1)


# --- stored conversations ---------------------------------------------------------------

STRETCHES = pa.schema(
    [("conv", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("before", pa.binary()), ("own", pa.binary()),
     ("turns", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))]
)


def stretches(conversations: DataFrame, prints: Fingerprints, most: int = 256) -> DataFrame:
    """Bounded stretches of one conversation each: the digests and text sizes of its turns,
    how many turns of the conversation come before in the same range (`first`), and their
    product (`before`). `part` numbers the ranges in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    turn = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    slim = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), F.unhex(turn).alias("digest"), size.alias("size"))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = slim.repartitionByRange(width(slim), *order).sortWithinPartitions(*order).select("conv_id", "digest", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        key, first, before, turns, sizes = None, 0, prints.EMPTY, [], []

        def close() -> None:
            nonlocal first, before, turns, sizes
            own = prints.product(turns)
            out.append((key, part, first, written(before), written(own), turns, sizes))
            first, before, turns, sizes = first + len(turns), prints.join(before, own), [], []

        for batch in batches:
            for conv, digest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and (conv != key or len(turns) >= most):
                    close()
                if conv != key:
                    key, first, before = conv, 0, prints.EMPTY
                turns.append(digest)
                sizes.append(n)
            if out:
                yield to_batch(out, STRETCHES)
                out = []
        if turns:
            close()
            yield to_batch(out, STRETCHES)

    return dealt.mapInArrow(run, "conv long, part int, first long, before binary, own binary, turns array<binary>, sizes array<long>")


def carries(parts: DataFrame, prints: Fingerprints) -> DataFrame:
    """(conv, part, n_before, carry): turns of the conversation in earlier ranges and their
    product, for ranges that continue a conversation; at most one row per range."""

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        rows, count, total = [], 0, prints.EMPTY
        for r in group.sort_values("part").itertuples():
            rows.append((r.conv, r.part, count, written(total)))
            count, total = count + r.n, prints.join(total, read(r.product))
        return pd.DataFrame(rows[1:], columns=["conv", "part", "n_before", "carry"])

    several = parts.groupBy("conv").agg(F.count("*").alias("ranges")).where("ranges > 1").select("conv")
    return parts.join(several, "conv", "left_semi").groupBy("conv").applyInPandas(chain, "conv long, part int, n_before long, carry binary")


ROWS = pa.schema(
    [("conv", pa.int64()), ("depth", pa.int64()), ("print", pa.binary()), ("above", pa.binary()), ("ref_conv", pa.int64()),
     ("ref_place", pa.int64()), ("turn", pa.binary()), ("size", pa.int64()), ("last", pa.bool_())]
)


def rebuilt(conversations: DataFrame, prints: Fingerprints) -> DataFrame:
    """One row per rebuilt conversation and depth, from 0: its fingerprint, that of the depth
    above, and the reference to its last turn. `last` marks the whole conversation."""
    cut = materialise(stretches(conversations, prints))
    ends = cut.groupBy("conv", "part").agg(
        F.sum(F.size("turns")).cast("long").alias("n"), F.max(F.struct("first", "before", "own")).alias("end")
    )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            products = [written(prints.join(read(e["before"]), read(e["own"]))) for e in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(products, pa.binary())], names=["conv", "part", "n", "product"])

    parts = materialise(ends.mapInArrow(total, "conv long, part int, n long, product binary"))
    carried = materialise(carries(parts, prints))
    placed = parts.join(F.broadcast(carried), ["conv", "part"], "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    # The first turns of every conversation; bounded, as no more than HEAD are kept.
    fronts = cut.where(F.col("first") < HEAD).join(placed.where(F.col("n_before") < HEAD).select("conv", "part", "n_before"), ["conv", "part"])
    front = fronts.select("conv", (F.col("first") + F.col("n_before")).alias("at"), F.slice("turns", 1, HEAD).alias("t"), F.slice("sizes", 1, HEAD).alias("s"))
    heads = front.where(F.col("at") < HEAD).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "t", "s"))).alias("fronts"))
    heads = materialise(heads.select("conv", F.slice(F.flatten("fronts.t"), 1, HEAD).alias("turns"), F.slice(F.flatten("fronts.s"), 1, HEAD).alias("sizes")))
    counts = parts.groupBy("conv").agg(F.sum("n").alias("n_turns"))
    base = heads.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"), F.col("sizes").alias("base_sizes"))
    # Five conversations at most have one base.
    known = counts.withColumn("base", F.col("conv") - F.col("conv") % 5).join(base, "base", "left").join(heads.select("conv", F.col("turns").alias("head")), "conv")
    # Met per range, so that a conversation over many ranges is met in many places.
    per_range = placed.select("conv", "part", "n_before", "carry").join(known, "conv")
    joined = cut.select("conv", "part", "first", "before", "turns", "sizes").join(materialise(per_range), ["conv", "part"])
    columns = ["conv", "first", "before", "turns", "sizes", "n_before", "carry", "n_turns", "base", "base_turns", "base_sizes", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):  # one row at a time, as stretches are long
                out += _depths({c: batch.column(c)[i].as_py() for c in columns}, prints)
                if len(out) > 4000:
                    yield to_batch(out, ROWS)
                    out = []
            if out:
                yield to_batch(out, ROWS)

    return joined.select(*columns).mapInArrow(
        run, "conv long, depth long, print binary, above binary, ref_conv long, ref_place long, turn binary, size long, last boolean"
    )


def _depths(row: dict, prints: Fingerprints) -> Iterator[tuple]:
    """The depths that a stretch of a conversation adds; its first one adds the root and the head."""
    conv, base, cut = row["conv"], row["base"], head_length(row["conv"])
    head, sizes = (row["base_turns"] or [])[:cut], (row["base_sizes"] or [])[:cut]
    shown = lambda element: element[0].to_bytes(16, "big")
    whole = len(head) + max(0, row["n_turns"] - cut)
    at = prints.EMPTY
    start = row["n_before"] + row["first"]
    if start == 0:
        yield conv, 0, shown(at), b"", conv, 0, b"", 0, whole == 0
    for i, turn in enumerate(head, 1):
        above, at = at, prints.join(at, prints.of(turn))
        if start == 0:
            yield conv, i, shown(at), shown(above), base, i, turn, sizes[i - 1], i == whole
    joined, own = at, prints.product(row["head"][:cut])  # base head; own turns that it replaces
    so_far = prints.join(read(row["carry"]) if row["carry"] else prints.EMPTY, read(row["before"]))
    for place, (turn, size) in enumerate(zip(row["turns"], row["sizes"], strict=True), start + 1):
        if place > cut:
            above = prints.join(joined, prints.without(so_far, own, cut))
            at = prints.join(above, prints.of(turn))
            depth = len(head) + place - cut
            yield conv, depth, shown(at), shown(above), conv, place, turn, size, depth == whole
        so_far = prints.join(so_far, prints.of(turn))


# --- the trie ---------------------------------------------------------------------------


def ends_hashes(ends: DataFrame, piece: int = 4096) -> DataFrame:
    """(depth, print, ends_sha256): the hash over the ids of the conversations (depth, print,
    conv) that end at a node, in numeric order, comma-joined.

    Ids are sorted by range and written as pieces of bounded length; the hash of a node is
    fed with its pieces one by one.
    """
    order = ["depth", "print", "conv"]
    dealt = ends.select(*order).repartitionByRange(width(ends), *order).sortWithinPartitions(*order)
    pieces = pa.schema([("depth", pa.int64()), ("print", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for depth, mark, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and ((depth, mark) != key or len(ids) >= piece):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = depth, mark
                ids.append(conv)
            if out:
                yield to_batch(out, pieces)
                out = []
        if ids:
            yield to_batch([(*key, ids[0], ",".join(map(str, ids)))], pieces)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        schema = pa.schema([("depth", pa.int64()), ("print", pa.binary()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for depth, mark, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, mark) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, mark), hashlib.sha256(ids.encode())
            if out:
                yield to_batch(out, schema)
        if key is not None:
            yield to_batch([(*key, state.hexdigest())], schema)

    parts = dealt.mapInArrow(cut, "depth long, print binary, first long, ids string")
    grouped = parts.repartition(width(ends), "depth", "print").sortWithinPartitions("depth", "print", "first")
    return grouped.mapInArrow(fold, "depth long, print binary, ends_sha256 string")


def trie(conversations: DataFrame, attempts: int = 8, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes that sharing saves in its subtree), ends_sha256,
    and ref_conv, ref_place: where the text of its last turn is stored."""
    own = own_columns(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    own = own.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    for seed in range(attempts):
        rows = materialise(rebuilt(own, Fingerprints(seed)))
        same = [F.min("turn") != F.max("turn"), F.min("above") != F.max("above"), F.min("size") != F.max("size")]
        nodes = materialise(
            rows.groupBy("depth", "print").agg(
                F.min("conv").alias("rep"),
                F.min("above").alias("above"),
                F.min(F.struct("ref_conv", "ref_place")).alias("ref"),
                F.count("*").alias("n_convs"),
                F.min("size").alias("size"),
                (same[0] | same[1] | same[2]).alias("clash"),
            )
        )
        if nodes.where("clash").isEmpty():
            return _with_sums(rows, nodes)
    raise ValueError(f"{attempts} multipliers in a row gave equal fingerprints of different prefixes")


def _with_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    key = ["depth", "print"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("print")).agg(F.count("*").alias("n_children"))
    worth = (F.col("n_convs") - 1) * F.col("size")
    sized = nodes.join(children, key, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), worth.alias("worth"))
    # Below a node, along its own conversation: what the nodes of that conversation save from here on.
    along = materialise(running(sized, ["rep"], [F.desc("depth")], {"along": F.col("worth")}))
    owned = along.groupBy("rep").agg(
        F.sum("worth").alias("all_worth"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min("depth").alias("from_depth")
    )
    # Conversations that own no node with a sum need not be met.
    weights = materialise(owned.where("all_worth > 0 OR leaf > 0"))
    block = 4096  # a long conversation meets its weights once per so many depths
    lengths = rows.where("last").select(F.col("conv").alias("rep"), F.col("depth").alias("length"))
    spread = weights.join(lengths, "rep").select("rep", "all_worth", "leaf", F.explode(F.sequence(F.lit(0), F.expr(f"cast(length div {block} AS int)"))).alias("block"))
    members = rows.select(*key, F.col("conv").alias("rep"), F.expr(f"cast(depth div {block} AS int)").alias("block"))
    sums = members.join(spread, ["rep", "block"]).groupBy(*key).agg(F.sum("all_worth").alias("members_worth"), F.sum("leaf").alias("n_leaves"))
    total = along.join(sums, key, "left").join(owned.select("rep", F.col("all_worth").alias("rep_worth"), "from_depth"), "rep")
    ends = ends_hashes(rows.where("last"))
    full = total.join(ends, key, "left").select(
        F.col("rep").alias("conv_id"), "depth", "above", "print", "from_depth", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("members_worth", F.lit(0)) - F.col("rep_worth") + F.col("along")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("ref.ref_conv").alias("ref_conv"), F.col("ref.ref_place").alias("ref_place"),
    )
    full = materialise(full)
    # A conversation owns the nodes from some depth on; only the first hangs from another's.
    first = (F.col("depth") == F.col("from_depth")) & (F.col("depth") > 0)
    tops = full.where(first).withColumn("depth", F.col("depth") - 1)
    parents = nodes.where("depth >= 0").select("depth", F.col("print").alias("above"), F.col("rep").alias("parent_conv_id"))
    needed = parents.join(children.select("depth", F.col("print").alias("above")), ["depth", "above"], "left_semi")
    met = salted_join(tops, needed, ["depth", "above"], ["print"], salts=8).withColumn("depth", F.col("depth") + 1)
    rest = full.where(~first).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "ref_conv", "ref_place"]
    return rest.select(*out).unionByName(met.select(*out))
