"""Rankings and row numbers that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.session import materialise


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group. Spark keeps only k rows per group and task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums per group (or overall) along `order`, own row included, for groups of any size.

    Rows are dealt by range of group and order and written with the number of their
    range. A group that reaches over several ranges carries its totals from one to the
    next; every range continues at most one group, so there are no more carried rows
    than ranges. Nulls are a group of their own; rows equal in `order` get some order.
    """
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, *order)
    rows = materialise(dealt.withColumn("_range", F.spark_partition_id()))
    totals = rows.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_range").alias("_at"),
        *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)],
        *[F.sum(f"_{n}").over(before).alias(f"_before_{n}") for n in sums],
        F.lag(F.lit(1)).over(before.rowsBetween(-1, -1)).alias("_more"),
    ).where("_more = 1")
    same = F.col("_range") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("*", *[F.sum(c).over(inside).alias(f"_within_{n}") for n, c in sums.items()])
    return counted.join(F.broadcast(carried), same, "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_within_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in sums],
    )


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str = "index") -> DataFrame:
    """Row numbers from 1 per group (or overall) along `order`, for groups of any size."""
    return running(df, group, order, {out: F.lit(1).cast("bigint")})


def average_ranks(df: DataFrame, value: str, bucket: Column, out: str = "rank") -> DataFrame:
    """(value, n, rank) per distinct value: ties share the mean of their ranks.

    Counts per distinct value come first; `bucket` splits the value range into a
    bounded number of parts whose totals give the offsets.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n")).withColumn("_bucket", bucket)
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("_bucket")
        .agg(F.sum("n").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return counts.join(offsets, "_bucket").select(value, "n", (below + (F.col("n") + 1) / 2).alias(out))
