"""Months covered by possibly overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_months(
    spans: DataFrame, keys: list[str], start: str = "start_m", end: str = "end_m", out: str = "months"
) -> DataFrame:
    """Months covered per key, overlap and touching spans counted once.

    Spans are first reduced to one per (key, start month) with map-side
    aggregation, so the window sees at most one row per calendar month however
    many spans a hot key has. Each row then adds only what lies beyond the
    furthest end seen before it.
    """
    reduced = (
        spans.filter(F.col(start).isNotNull()).groupBy(*keys, start).agg(F.max(end).alias(end))
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.coalesce(F.max(end).over(earlier), F.col(start))
    added = F.greatest(F.col(end) - F.greatest(F.col(start), reached), F.lit(0))
    return (
        reduced.withColumn("_added", added)
        .groupBy(*keys)
        .agg(F.sum("_added").cast("bigint").alias(out))
    )


def merged_spans(
    spans: DataFrame, keys: list[str], start: str = "start_m", end: str = "end_m"
) -> DataFrame:
    """Per key: `months` covered and `spans`, the disjoint merged spans in order.

    Rows without a start month only make their key appear. Reduced to one span
    per (key, start month) first, like `merged_months`; the collected list is
    shorter still, at most one entry per second calendar month.
    """
    known_end = F.when(F.col(start).isNotNull(), F.col(end))
    reduced = spans.groupBy(*keys, start).agg(F.max(known_end).alias(end))
    ordered = Window.partitionBy(*keys).orderBy(start)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.max(end).over(earlier) < F.col(start), F.lit(True))
    islands = (
        reduced.withColumn("_opens", opens.cast("int"))
        .withColumn("_island", F.sum("_opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias("s"), F.max(end).alias("e"))
    )
    return islands.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("e") - F.col("s")).cast("bigint"), F.lit(0).cast("bigint")).alias("months"),
        F.array_sort(
            F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "e")))
        ).alias("spans"),
    )


def union_months(months: str, spans: str) -> Column:
    """Aggregate: months covered by the union of a few merged span lists.

    One list needs no merging. Several are walked in start order, each span
    adding what lies beyond the furthest end so far.
    """
    lists = F.collect_list(F.when(F.col(months).isNotNull(), F.struct(months, spans)))
    far_past = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-1).alias("reach"))

    def step(state: Column, span: Column) -> Column:
        gained = F.greatest(span["e"] - F.greatest(span["s"], state["reach"]), F.lit(0))
        return F.struct(
            (state["total"] + gained).alias("total"), F.greatest(state["reach"], span["e"]).alias("reach")
        )

    walked = F.aggregate(
        F.array_sort(F.flatten(F.transform(lists, lambda x: x[spans]))), far_past, step, lambda s: s["total"]
    )
    return F.when(F.size(lists) == 1, F.element_at(lists, 1)[months]).otherwise(walked)
