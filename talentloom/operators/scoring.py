"""The five dimensions and their weighted total, per (candidate, job) pair. Nothing is
rounded before the total; vectors meet in `blocks`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.constants import (
    COSINE_MAX,
    COSINE_MIN,
    DEFAULT_WEIGHTS,
    DIMENSIONS,
    MAX_MINUTES_ONSITE,
    MAX_MINUTES_OTHER,
    NEUTRAL,
)
from talentloom.functions.strings import half_even, is_blank
from talentloom.session import salted_join


# --- D1 -------------------------------------------------------------------------


def unit_vectors(vectors: DataFrame, id_column: str, vector: str = "embedding") -> DataFrame:
    """Vectors scaled to length 1 once per side; a zero vector stays zero, an empty one is null."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    sized = vectors.withColumn("_norm", norm)
    unit = F.transform(vector, lambda x: F.when(F.col("_norm") > 0, F.try_divide(x.cast("double"), F.col("_norm"))).otherwise(0.0))
    return sized.select(id_column, F.when(F.size(vector) > 0, unit).alias("unit"))


def semantic_score(similarity: Column, low: float = COSINE_MIN, high: float = COSINE_MAX) -> Column:
    """Cosine stretched to [0, 1]; neutral where a vector is missing.

    least and greatest skip nulls, so a missing cosine is settled first.
    """
    stretched = F.least((similarity - low) / (high - low), F.lit(1.0))
    return F.when(similarity.isNull(), NEUTRAL).otherwise(F.greatest(stretched, F.lit(0.0)))


# --- D2 -------------------------------------------------------------------------


def skill_scores(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    sums = evidence.groupBy("cv_id", "jd_id").agg(
        F.sum(F.col("weight") * F.col("credit")).alias("got"), F.sum("weight").alias("total")
    )
    return pairs.select("cv_id", "jd_id").join(sums, ["cv_id", "jd_id"], "left").select(
        "cv_id", "jd_id", F.when(F.col("total") > 0, F.try_divide("got", "total")).otherwise(1.0).alias("skills")
    )


# --- D3 -------------------------------------------------------------------------


def counted_months(months: Column | str, years: Column | str) -> Column:
    """Months spent on a group as far as they are asked for. A job asks the same years of
    all its groups, so their weighted sum, a whole number, gives the depth by one division."""
    m = F.col(months) if isinstance(months, str) else months
    y = F.col(years) if isinstance(years, str) else years
    return F.least(F.coalesce(m, F.lit(0)), y * 12)


def years_share(months: Column | str, years: Column | str) -> Column:
    m = F.col(months) if isinstance(months, str) else months
    y = F.col(years) if isinstance(years, str) else years
    return F.least(F.try_divide(F.coalesce(m, F.lit(0)) / 12.0, y), F.lit(1.0))


def experience_score(years: Column | str, depth: Column | str, general: Column | str) -> Column:
    """1 if no years are required; half depth and half years, or years alone."""
    y, d, g = (F.col(c) if isinstance(c, str) else c for c in (years, depth, general))
    blend = F.when(d.isNull(), g).otherwise((d + g) / 2)
    return F.when(y == 0, 1.0).otherwise(blend)


# --- D4, D5 -----------------------------------------------------------------------


def education_score(cv_rank: Column | str, jd_rank: Column | str) -> Column:
    cv = F.col(cv_rank) if isinstance(cv_rank, str) else cv_rank
    jd = F.col(jd_rank) if isinstance(jd_rank, str) else jd_rank
    return (
        F.when(F.coalesce(jd, F.lit(0)) == 0, 1.0)
        .when(F.coalesce(cv, F.lit(0)) == 0, NEUTRAL)
        .otherwise(F.least(F.try_divide(cv, jd), F.lit(1.0)))
    )


def location_score(
    work_mode: Column,
    relocate: Column,
    cv_address: Column,
    cv_city: Column,
    jd_city: Column,
    has_coordinates: Column,
    minutes: Column,
) -> Column:
    longest = F.when(work_mode == "onsite", MAX_MINUTES_ONSITE).otherwise(MAX_MINUTES_OTHER)
    return (
        F.when(work_mode == "remote", 1.0)
        .when(relocate, 1.0)
        .when(is_blank(cv_address) & is_blank(cv_city), NEUTRAL)
        .when(is_blank(cv_address), F.when(cv_city == jd_city, NEUTRAL).otherwise(0.0))
        .when(~has_coordinates, NEUTRAL)
        .when(minutes.isNull(), NEUTRAL)
        .otherwise(half_even(F.greatest(F.lit(0.0), 1 - minutes / longest), 3))
    )


def geocode(places: DataFrame, address: str, gazetteer: DataFrame) -> DataFrame:
    """Add lat, lng: the full address, else its last comma segment, else null."""
    segments = F.filter(
        F.transform(F.split(F.col(address), ","), lambda s: F.trim(s)), lambda s: s != ""
    )
    known = gazetteer.groupBy("address").agg(F.min(F.struct("lat", "lng")).alias("place"))
    full = known.select(F.col("address").alias("_full"), F.col("place").alias("_at_full"))
    tail = known.select(F.col("address").alias("_tail"), F.col("place").alias("_at_tail"))
    found = (
        places.withColumn("_full", F.when(~is_blank(address), F.trim(address)))
        .withColumn("_tail", F.when(F.size(segments) > 1, F.element_at(segments, -1)))
        .join(full, "_full", "left")
        .join(tail, "_tail", "left")
    )
    at = F.coalesce("_at_full", "_at_tail")
    return found.withColumn("lat", at["lat"]).withColumn("lng", at["lng"]).drop(
        "_full", "_tail", "_at_full", "_at_tail"
    )


def has_coordinates() -> Column:
    return F.col("lat1").isNotNull() & F.col("lng1").isNotNull() & F.col("lat2").isNotNull() & F.col("lng2").isNotNull()


def with_minutes(placed: DataFrame, routes: DataFrame) -> DataFrame:
    """`placed` pairs with the driving minutes between their coordinates, null without a route.

    Only pairs whose score depends on a route look for one. The others, most of all pairs,
    would meet in one task as null keys; they are spread by candidate and job instead.
    """
    needs = (F.col("work_mode") != "remote") & ~F.coalesce("willing_to_relocate", F.lit(False)) & ~is_blank("raw_address") & has_coordinates()
    spread = F.when(F.coalesce(needs, F.lit(False)), F.lit(-1)).otherwise(F.pmod(F.xxhash64("cv_id", "jd_id"), F.lit(1 << 20)).cast("int"))
    ways = routes.withColumn("_spread", F.lit(-1))
    return placed.withColumn("_spread", spread).join(ways, ["lat1", "lng1", "lat2", "lng2", "_spread"], "left").drop("_spread")


def location_scores(pairs: DataFrame, candidates: DataFrame, jobs: DataFrame, routes: DataFrame) -> DataFrame:
    """candidates(cv_id, city, raw_address, willing_to_relocate, lat, lng),
    jobs(jd_id, city, work_mode, lat, lng), routes(lat1, lng1, lat2, lng2, duration_min)."""
    cv = candidates.select(
        "cv_id", F.col("city").alias("cv_city"), "raw_address", "willing_to_relocate",
        F.col("lat").alias("lat1"), F.col("lng").alias("lng1"),
    )
    jd = jobs.select(
        "jd_id", F.col("city").alias("jd_city"), "work_mode",
        F.col("lat").alias("lat2"), F.col("lng").alias("lng2"),
    )
    placed = salted_join(pairs.select("cv_id", "jd_id"), jd, ["jd_id"], ["cv_id"]).join(cv, "cv_id")
    located = with_minutes(placed, routes)
    coordinates = has_coordinates()
    score = location_score(
        F.col("work_mode"), F.col("willing_to_relocate"), F.col("raw_address"), F.col("cv_city"),
        F.col("jd_city"), coordinates, F.col("duration_min"),
    )
    return located.select("cv_id", "jd_id", score.alias("location"))


# --- totals -----------------------------------------------------------------------


def weighted_total(weights: Column | None = None) -> Column:
    """100 * sum of dimension * weight; a dimension without a weight counts 0."""
    total = F.lit(0.0)
    for name in DIMENSIONS:
        weight = F.lit(DEFAULT_WEIGHTS[name]) if weights is None else F.coalesce(weights[name], F.lit(0.0))
        total = total + F.col(name) * weight
    return 100 * total


def final_scores(dimensions: DataFrame, weights: Column | None = None) -> DataFrame:
    """final_score and each dimension in percent, one decimal."""
    keep = [c for c in dimensions.columns if c not in DIMENSIONS]
    return dimensions.select(
        *keep,
        half_even(weighted_total(weights), 1).alias("final_score"),
        *[half_even(F.col(name) * 100, 1).alias(name) for name in DIMENSIONS],
    )
