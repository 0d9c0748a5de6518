"""Resolving skill names against the alias table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.functions.skills import spelling_variants
from talentloom.functions.strings import strip


def resolve_names(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Distinct `name` with canonical, found, matched_key and kind.

    The first spelling variant listed in the alias table decides. Only distinct
    names are looked up; the alias side is broadcast by Spark when it is small.
    """
    distinct = names.select(name).filter(F.col(name).isNotNull()).distinct()
    variants = distinct.select(name, F.posexplode(spelling_variants(name)).alias("pos", "alias"))
    best = (
        variants.join(aliases, "alias")
        .groupBy(name)
        .agg(F.min_by(F.struct("alias", "canonical"), "pos").alias("hit"))
    )
    key, target = F.col("hit.alias"), F.col("hit.canonical")
    return distinct.join(best, name, "left").select(
        name,
        F.coalesce(target, key, F.lower(strip(name))).alias("canonical"),
        F.col("hit").isNotNull().alias("found"),
        F.coalesce(key, F.lit("")).alias("matched_key"),
        F.when(F.col("hit").isNull(), "not_found")
        .when(target.isNull(), "self_canonical")
        .otherwise("synonym")
        .alias("kind"),
    )


def implied_by(expectations: DataFrame, aliases: DataFrame, implies: DataFrame) -> DataFrame:
    """Does the canonical of `child` imply the canonical of `parent`?"""
    resolved = resolve_names(
        expectations.select(F.col("child").alias("name")).union(
            expectations.select(F.col("parent").alias("name"))
        ),
        aliases,
    )
    child = resolved.select(F.col("name").alias("child"), F.col("canonical").alias("child_canonical"))
    parent = resolved.select(F.col("name").alias("parent"), F.col("canonical").alias("parent_canonical"))
    edges = implies.select(
        F.col("src").alias("child_canonical"), F.col("dst").alias("parent_canonical"), F.lit(True).alias("edge")
    ).distinct()
    return (
        expectations.join(child, "child", "left")
        .join(parent, "parent", "left")
        .join(edges, ["child_canonical", "parent_canonical"], "left")
        .withColumn("found", F.coalesce("edge", F.lit(False)))
        .drop("edge")
    )
