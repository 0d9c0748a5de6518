"""Nearest neighbours by multi-index hashing.

Vectors become binary codes: principal axes of a bounded sample, rotated several times
so that signs keep as much of the vector as they can. A code is split into substrings.
If two codes differ in at most r of their bits, then for any thresholds t_j with
sum(t_j + 1) = r + 1 some substring j differs in at most t_j bits (pigeonhole); so
looking up, in an index per substring, the values within t_j of the query's retrieves
every code within the radius. Those are ranked by exact inner products.

Largest inner product becomes smallest angle by one more dimension, which brings all
vectors to the same length. The radius is calibrated: the exact neighbours of a bounded
number of sample queries among all vectors tell how far, in bits, true neighbours lie.
Queries that find fewer than k vectors within it are asked again with a doubled radius,
up to all bits, so that every query ends with k.

All vectors are indexed, in blocks; a block's index is built where it is used. Queries
meet blocks by an equi-join on block numbers, and each block returns its best few.

Defined results: vectors that are null, of another length than most, zero, or hold null
or non-finite components take no part; ties go to the smaller id; rows repeated with one
id are candidates each; ids that are null take no part. Fewer candidates than k give all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import own_columns
from talentloom.session import materialise


@dataclass(frozen=True)
class Codes:
    """What turns vectors into codes; its size depends on the dimension only."""

    longest: float
    axes: np.ndarray  # (dimension + 1, bits)
    substrings: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(n, substrings) of 16 bits each; signs do not change with a vector's length."""
        norms = (vectors**2).sum(axis=1)
        rest = np.sqrt(np.maximum(self.longest**2 - norms, 0))
        bits = np.column_stack([vectors, rest]) @ self.axes > 0
        return np.packbits(bits, axis=1).view(np.uint16)

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        bits = vectors @ self.axes[:-1] > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn_codes(sample: np.ndarray, longest: float, rotations: int = 4, rounds: int = 30) -> Codes:
    """Principal axes of the sample, turned until the signs fit the projections best."""
    lifted = np.column_stack([sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(axis=1), 0))])
    use = sample.shape[1] - sample.shape[1] % 16 or 16
    _, _, basis = np.linalg.svd(lifted, full_matrices=False)
    basis = basis[:use].T
    if basis.shape[1] < use:  # fewer sample rows or dimensions than bits
        basis = np.column_stack([basis, np.zeros((basis.shape[0], use - basis.shape[1]))])
    seen, source, axes = lifted @ basis, np.random.default_rng(4), []
    for _ in range(rotations):
        turn = np.linalg.qr(source.normal(size=(use, use)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(seen @ turn).T @ seen)
            turn = (u @ v).T
        axes.append(basis @ turn)
    axes = np.column_stack(axes)
    return Codes(longest, axes, axes.shape[1] // 16)


def thresholds(radius: int, substrings: int) -> np.ndarray:
    """Bits in which each substring may differ; -1 where it need not be looked up."""
    each, more = divmod(radius + 1, substrings)
    return np.array([each + (j < more) - 1 for j in range(substrings)])


class Index:
    """The codes of a block, with the rows of every value of every substring."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((values, np.diff(np.append(starts, len(column))), order))

    def within(self, query: np.ndarray, radius: int, allowed: np.ndarray) -> np.ndarray:
        """All rows whose code differs from the query's in at most `radius` bits."""
        met = np.zeros(len(self.codes), bool)
        for (values, counts, order), part, most in zip(self.tables, query, allowed, strict=True):
            if most >= 0:
                near = np.bitwise_count(values ^ part) <= most
                met[order[np.repeat(near, counts)]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ query).sum(axis=1, dtype=np.int64) <= radius]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:  # leave out what is below the k-th score, keep all ties
        places = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): vectors that take part, in double precision."""
    own = own_columns(df, id=vec_id, v=vector)
    own = own.select(F.col("id").cast("long"), F.col("v").cast("array<double>"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return own.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def _pairs(base: DataFrame, queries: DataFrame, blocks: int, query_rows: int, search) -> DataFrame:
    """Runs `search(queries, block)` for every chunk of queries and block of vectors."""
    chunks = queries.count() // query_rows + 1
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = base.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return asked.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )


def _search(codes: Codes | None, radius: int, k: int):
    """Top k of each query within a block: through the index, or of all if no codes."""

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            vectors, ids = np.stack(held["v"].to_numpy()), held["id"].to_numpy()
            wanted = np.stack(asked["v"].to_numpy())
            if codes is not None:
                index, signs, allowed = Index(codes.of(vectors)), codes.of_queries(wanted), thresholds(radius, codes.substrings)
            for i, (query, vector) in enumerate(zip(asked["id"], wanted, strict=True)):
                rows = np.arange(len(ids)) if codes is None else index.within(signs[i], radius, allowed)
                rows = rows[ids[rows] != query]
                scores = np.einsum("ij,j->i", vectors[rows], vector)
                best = _best(ids[rows], scores, k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[rows][best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "vec_id", "score")})

    return search


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(base: DataFrame, codes: Codes, k: int, blocks: int, queries: int, share: float) -> int:
    """The radius that holds this share of the true neighbours of sample queries, which
    are the bounded number of vectors with the smallest hash."""
    asked = base.orderBy(F.xxhash64("id", F.lit(7))).limit(queries)
    exact = _top(_pairs(base, asked, blocks, queries, _search(None, 0, k)), k)
    one = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    rows = exact.join(one, "query_id").join(base.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("q", "v").toPandas()
    if rows.empty:
        return codes.substrings * 16
    apart = np.bitwise_count(codes.of_queries(np.stack(rows["q"])) ^ codes.of(np.stack(rows["v"]))).sum(axis=1)
    return int(np.quantile(apart, share, method="higher"))


def _short(asked: DataFrame, base: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The queries that have found fewer than k vectors and have not found all candidates."""
    candidates = base.count() - F.coalesce("own", F.lit(0))
    own = base.groupBy("id").agg(F.count("*").alias("own"))
    met = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("met"))
    each = asked.groupBy("id").agg(F.count("*").alias("times"))
    least = F.col("times") * F.least(F.lit(k), candidates)
    few = each.join(own, "id", "left").join(met, "id", "left").where(F.coalesce("met", F.lit(0)) < least)
    return asked.join(few.select("id"), "id", "left_semi")


def neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    sample_rows: int = 10_000,
    calibration_queries: int = 100,
    share: float = 0.97,
    block_rows: int = 8192,
    query_rows: int = 4096,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query.

    Codes are fitted on at most `sample_rows` vectors (those with the smallest hash), the
    radius on `calibration_queries` queries against all vectors; every vector is indexed.
    A query has fewer than k rows only if there are fewer candidates. Rows of `queries` that
    repeat id and vector ask once; no row with the id of the query is its neighbour; other
    repeated rows of `vectors` are candidates each. Extra columns, whatever their names, are
    not read.
    """
    base = usable(vectors, vec_id, vector)
    sizes = base.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    base = materialise(base.where(F.size("v") == size))
    asked = usable(queries, vec_id, vector).where(F.size("v") == size).dropDuplicates(["id", "v"])
    if not size:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, square = base.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    sample = base.orderBy(F.xxhash64("id")).limit(sample_rows).toPandas()
    codes = learn_codes(np.stack(sample["v"].to_numpy()), math.sqrt(square))
    blocks = rows // block_rows + 1
    radius = calibrate(base, codes, k, blocks, calibration_queries, share)
    asked = materialise(asked)
    found = materialise(_pairs(base, asked, blocks, query_rows, _search(codes, radius, k)))
    bits = codes.substrings * 16
    while radius < bits:
        asked = materialise(_short(asked, base, found, k))
        if asked.isEmpty():
            break
        radius = min(max(2 * radius, 16), bits)
        wider = _pairs(base, asked, blocks, query_rows, _search(codes, radius, k))
        again = asked.select(F.col("id").alias("query_id")).distinct()
        found = materialise(found.join(again, "query_id", "left_anti").unionByName(wider))
    return _top(found, k)
