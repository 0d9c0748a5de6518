"""Spelling variants of names, and filling a test corpus up with them."""

from __future__ import annotations

from string import ascii_lowercase as LOWER

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rewrites(c: Column) -> Column:
    """The ten ways a name may be written otherwise."""
    dashed = F.replace(c, F.lit(" "), F.lit("-"))
    # A capital after everything that is no letter, as in Node.Js.
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    title = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")
    return F.array(
        dashed, F.replace(c, F.lit("."), F.lit("")), F.replace(c, F.lit("-"), F.lit(" ")), F.upper(c), F.lower(c), title,
        F.translate(c, LOWER + LOWER.upper(), LOWER.upper() + LOWER), F.upper(dashed), F.lower(dashed), F.replace(c, F.lit(" "), F.lit("_")),
    )


def all_variants(base: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """The rows of `base` and, once each, the rewrites of `name` that are no written name.

    Adds `origin` and `fill_order`, a seeded hash (null for written rows). A rewrite keeps the
    other columns of the row it comes from, of several the least.
    """
    others = [c for c in base.columns if c != name]
    made = base.select(F.explode(rewrites(F.col(name))).alias(name), *others).where(F.col(name) != "")
    kept = F.min(F.struct(*others)).alias("_kept") if others else F.lit(None).alias("_kept")
    fresh = made.groupBy(name).agg(kept).join(base.select(name), name, "left_anti")
    order = F.sha2(F.concat(F.lit(f"{seed}\u0001"), name), 256)
    fresh = fresh.select(name, *[F.col("_kept")[c].alias(c) for c in others], F.lit("variant").alias("origin"), order.alias("fill_order"))
    return base.withColumn("origin", F.lit("written")).withColumn("fill_order", F.lit(None).cast("string")).unionByName(fresh)


def filled(base: DataFrame, name: str, target: int, seed: int = 42, digits: int = 4) -> DataFrame:
    """`base` filled up to `target` rows with the variants of smallest hash; cut to the rows of
    smallest (hash, name) where it has more.

    No global sort: counts per hash prefix (16 ** `digits` at most) say which prefixes come in
    whole, and only the prefix that `target` falls into is put in order.
    """
    rows = all_variants(base, name, seed)
    written = base.count()
    own = F.sha2(F.concat(F.lit(f"{seed}\u0001"), F.coalesce(name, F.lit(""))), 256)
    pool = (rows.where("origin = 'variant'") if written <= target else rows.where("origin = 'written'").withColumn("fill_order", own))
    wanted = target - written if written <= target else target
    cut = pool.withColumn("_prefix", F.left("fill_order", F.lit(digits)))
    counts = cut.groupBy("_prefix").count().orderBy("_prefix").collect()
    whole, last = 0, None
    for row in counts:
        last = row["_prefix"]
        if whole + row["count"] > wanted:
            break
        whole += row["count"]
    else:
        last = None
    if last is None:
        taken = cut
    else:
        edge = cut.where(F.col("_prefix") == last).orderBy("fill_order", name).limit(wanted - whole)
        taken = cut.where(F.col("_prefix") < last).unionByName(edge)
    taken = taken.drop("_prefix")
    return rows.where("origin = 'written'").unionByName(taken) if written <= target else taken
