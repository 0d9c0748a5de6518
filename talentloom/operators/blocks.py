"""Products of vectors for given pairs, in blocks.

A vector is long and a pair is short, so vectors must not travel with pairs. Pairs are cut
into the cells of a grid, candidate ranges by job ranges; a cell receives every vector it
needs once, multiplies with numpy, and gives back numbers only. Cells that hold many pairs,
because of a candidate or job with a large share of them, are cut by a finer grid of their
own, so a cell has a bounded number of pairs whatever the skew.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["_row", "_col", "_subrow", "_subcol"]


def _part(key: str, parts: Column | int, seed: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


def cells(pairs: DataFrame, a: str, b: str, per_cell: int) -> DataFrame:
    """`pairs` with its cell. `pairs` is read three times, so pass something written."""
    rows = pairs.count()
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = math.ceil(math.sqrt(max(least, rows / per_cell)))
    placed = pairs.select(a, b, _part(a, side, "row").alias("_row"), _part(b, side, "col").alias("_col"))
    # Few: each holds more than two cells' worth of pairs.
    full = placed.groupBy("_row", "_col").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * per_cell)
    cut = F.coalesce(F.ceil(F.col("_n") / per_cell), F.lit(1)).cast("int")
    return placed.join(full, ["_row", "_col"], "left").select(
        a, b, "_row", "_col", _part(a, cut, "subrow").alias("_subrow"), _part(b, cut, "subcol").alias("_subcol")
    )


def pair_cosines(
    pairs: DataFrame, a_vectors: DataFrame, b_vectors: DataFrame, a: str = "cv_id", b: str = "jd_id", vector: str = "embedding", per_cell: int = 200_000
) -> DataFrame:
    """(a, b, cosine, problem) once per distinct pair.

    A zero vector has cosine 0 with everything. The cosine is null where a vector is
    missing, empty or holds nulls, and where lengths differ; the last is named as problem.
    """
    placed = cells(pairs, a, b, per_cell)
    kind = {c: pairs.schema[c].dataType for c in (a, b)}
    there = placed.select(*[F.col(c).alias(f"{c}s") for c in CELL], a, b)
    to = [f"{c}s" for c in CELL]
    one = there.select(*to, a).distinct().join(a_vectors.select(a, F.col(vector).alias("_vector")), a)
    other = there.select(*to, b).distinct().join(b_vectors.select(b, F.col(vector).alias("_vector")), b)
    shipped = one.select(*to, a, F.lit(None).cast(kind[b]).alias(f"{b}_"), "_vector").toDF(*to, f"{a}_", f"{b}_", "_vector").unionByName(
        other.select(*to, F.lit(None).cast(kind[a]).alias(f"{a}_"), F.col(b).alias(f"{b}_"), "_vector")
    )

    # Nested, so that workers receive the functions themselves and need no install.
    def matrices(table: pa.Table, id_column: str) -> tuple[pa.Array, np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Ids, length of every vector, a matrix of unit rows per length, and each vector's row there."""
        own = table.filter(pc.is_valid(table[id_column])).combine_chunks()
        vectors = own["_vector"].combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.float64()))
        lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), np.int64)
        place, units = np.zeros(len(lengths), np.int64), {}
        for n in set(lengths[lengths > 0].tolist()):
            rows = np.flatnonzero(lengths == n)
            flat = vectors.take(pa.array(rows)).flatten()
            matrix = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), n)
            norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
            units[n] = np.divide(matrix, norm, out=np.where(np.isnan(norm), np.nan, np.zeros_like(matrix)), where=norm > 0)
            place[rows] = np.arange(len(rows))
        return own[id_column].combine_chunks(), lengths, units, place

    def multiply(asked: pa.Table, given: pa.Table) -> pa.Table:
        asked = asked.select([a, b]).group_by([a, b]).aggregate([])
        ids, lengths, units, place = matrices(given, f"{a}_")
        other_ids, other_lengths, other_units, other_place = matrices(given, f"{b}_")
        i = pc.fill_null(pc.index_in(asked[a].combine_chunks(), value_set=ids), -1).to_numpy(zero_copy_only=False)
        j = pc.fill_null(pc.index_in(asked[b].combine_chunks(), value_set=other_ids), -1).to_numpy(zero_copy_only=False)
        cosine, both = np.full(len(i), np.nan), (i >= 0) & (j >= 0)
        n, m = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        n[i >= 0], m[j >= 0] = lengths[i[i >= 0]], other_lengths[j[j >= 0]]
        for size, left in units.items():
            rows = np.flatnonzero(both & (n == size) & (m == size))
            for part in np.array_split(rows, len(rows) // 50_000 + 1):
                if len(part):
                    cosine[part] = np.einsum("ij,ij->i", left[place[i[part]]], other_units[size][other_place[j[part]]])
        unequal = (n > 0) & (m > 0) & (n != m)
        return pa.table(
            {a: asked[a], b: asked[b], "cosine": pa.array(cosine, mask=np.isnan(cosine)),
             "problem": pa.array(["vector length" if u else None for u in unequal] if unequal.any() else [None] * len(i), pa.string())}
        )

    names = {c: kind[c].simpleString() for c in (a, b)}
    return placed.groupBy(*CELL).cogroup(shipped.groupBy(*to)).applyInArrow(
        multiply, f"{a} {names[a]}, {b} {names[b]}, cosine double, problem string"
    )
