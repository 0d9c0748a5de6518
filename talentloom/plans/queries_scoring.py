"""The five dimensions, totals and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.constants import DIMENSIONS
from talentloom.functions import cleaning
from talentloom.functions.strings import half_even
from talentloom.operators import intervals, matching, ranking, scoring
from talentloom.plans import oracle as o
from talentloom.plans.queries_cleaning import weight_configs
from talentloom.plans.queries_matching import ranks
from talentloom.plans.queries_storage import stored
from talentloom.plans.registry import query
from talentloom.plans.screening import Screening
from talentloom.session import new_folder, salted_join
from talentloom.sources.sinks import score_table, write_score_table
from talentloom.sources.tables import Tables


@query("D1a_D1c_J11_cosine", o.sql("""
  SELECT a.cv_id, a.jd_id, coalesce(l.cosine, -9) AS cosine
  FROM applications a LEFT JOIN labelled_pairs l ON l.cv_id = a.cv_id AND l.jd_id = a.jd_id"""))
def _(t: Tables) -> DataFrame:
    """Every application's cosine; -9 marks a missing vector."""
    pairs = t.screening.cosines.select("cv_id", "jd_id", "cosine")
    return pairs.withColumn("cosine", F.coalesce(F.round("cosine", 6), F.lit(-9.0)))


@query("D1b_semantic", o.sql("SELECT cv_id, jd_id, round(semantic, 6) AS semantic FROM semantic"))
def _(t: Tables) -> DataFrame:
    semantic = scoring.semantic_score(F.col("cosine"))
    return t.screening.cosines.select("cv_id", "jd_id", F.round(semantic, 6).alias("semantic"))


@query("D2_skill_score", o.sql("SELECT cv_id, jd_id, round(skills, 9) AS skills FROM skills"))
def _(t: Tables) -> DataFrame:
    scores = t.screening.sliced(lambda s: scoring.skill_scores(s.applications, s.evidence), ("index", "hot"))
    return scores.withColumn("skills", F.round("skills", 9))


@query("D3a_D3b_total_months", o.sql(f"""
  SELECT cv_id, total_months, {o.half_even('total_months / 12.0::DOUBLE', 1)} AS total_years
  FROM (SELECT c.cv_id, coalesce(m.total_months, 0) AS total_months FROM candidates c LEFT JOIN total_months m ON m.cv_id = c.cv_id)"""))
def _(t: Tables) -> DataFrame:
    merged = intervals.merged_months(t.employment, ["cv_id"], out="total_months")
    months = t.candidates.select("cv_id").join(merged, "cv_id", "left").na.fill(0, ["total_months"])
    return months.withColumn("total_years", half_even(F.col("total_months") / 12, 1))


@query("D3c_group_months", o.sql("""
  SELECT a.cv_id, a.jd_id, g.req_pos::BIGINT AS req_pos, coalesce(m.months, 0)::BIGINT AS months
  FROM applications a JOIN groups g ON g.jd_id = a.jd_id AND g.tier = 'required'
  LEFT JOIN group_months m ON m.cv_id = a.cv_id AND m.jd_id = a.jd_id AND m.req_pos = g.req_pos"""))
def _(t: Tables) -> DataFrame:
    """Every required group of every application, those without any months included."""

    def every(s: Screening) -> DataFrame:
        required = s.groups.where("tier = 'required'").select("jd_id", "req_pos")
        return matching.asked_names(s.pairs, required).join(s.months, ["cv_id", "jd_id", "req_pos"], "left")

    months = t.screening.sliced(every, ("index", "hot"))
    return months.select("cv_id", "jd_id", F.col("req_pos").cast("bigint").alias("req_pos"), F.coalesce("months", F.lit(0)).alias("months"))


@query("D3d_D3_experience", o.sql("SELECT cv_id, jd_id, round(experience, 9) AS experience FROM experience_scores"))
def _(t: Tables) -> DataFrame:
    return t.screening.dimensions.select("cv_id", "jd_id", F.round("experience", 9).alias("experience"))


@query("D4_education", o.sql("SELECT cv_id, jd_id, round(education, 9) AS education FROM education"))
def _(t: Tables) -> DataFrame:
    return ranks(t).select(
        "cv_id", "jd_id", F.round(scoring.education_score("cv_rank", "jd_rank"), 9).alias("education")
    )


@query("J14_geocode", o.sql("""
  SELECT cv_id, coalesce(lat, -1) AS lat, coalesce(lng, -1) AS lng FROM candidates"""))
def _(t: Tables) -> DataFrame:
    return t.candidates.select(
        "cv_id", F.coalesce("lat", F.lit(-1.0)).alias("lat"), F.coalesce("lng", F.lit(-1.0)).alias("lng")
    )


@query("J15_D5_location", o.sql("SELECT cv_id, jd_id, location FROM location"))
def _(t: Tables) -> DataFrame:
    return scoring.location_scores(t.applications, t.candidates, t.jobs, t.routes)


@query("F1_final_score", o.sql("SELECT * FROM scores"))
def _(t: Tables) -> DataFrame:
    return t.screening.scores


_TOTAL = """100 * (0.0::DOUBLE + d.semantic * CASE WHEN c THEN 0.2 ELSE 0.3 END::DOUBLE + d.skills * CASE WHEN c THEN 0.4 ELSE 0.3 END::DOUBLE
  + d.experience * CASE WHEN c THEN 0.2 ELSE 0.25 END::DOUBLE + d.education * 0.1::DOUBLE + d.location * CASE WHEN c THEN 0.1 ELSE 0.05 END::DOUBLE)"""


@query("F2_rescore_with_config", o.sql(f"""
  SELECT cv_id, jd_id, {o.half_even(_TOTAL, 1)} AS final_score FROM (SELECT *, jd_id % 5 = 0 AS c FROM dims) d"""))
def _(t: Tables) -> DataFrame:
    """Dimensions stored once, then recombined with each job's own weights from the stored table alone."""
    configs = weight_configs(t).filter(cleaning.weights_problem("weights").isNull())
    table = stored(t, t.screening.dimensions.select("cv_id", "jd_id", *DIMENSIONS), ["cv_id", "jd_id"])
    scored = salted_join(table.read(), configs, ["jd_id"], ["cv_id"], "left")
    total = scoring.weighted_total(cleaning.weights_used("weights"))
    return scored.select("cv_id", "jd_id", half_even(total, 1).alias("final_score"))


@query("A1_top_ten_per_job", o.sql("""
  SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY final_score DESC, cv_id) AS rank FROM scores
  QUALIFY rank <= 10"""))
def _(t: Tables) -> DataFrame:
    order = [F.desc("final_score"), F.asc("cv_id")]
    return ranking.top_k(t.screening.scores, ["jd_id"], order, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("A2_global_ranking", o.sql("""
  SELECT cv_id, jd_id, final_score, row_number() OVER (ORDER BY final_score DESC, cv_id, jd_id) AS "index" FROM scores"""))
def _(t: Tables) -> DataFrame:
    order = [F.desc("final_score"), F.asc("cv_id"), F.asc("jd_id")]
    scores = t.screening.scores.select("cv_id", "jd_id", "final_score")
    return ranking.numbered(scores, [], order, "index")


@query("P32_score_range_violations", o.sql("""
  SELECT cv_id, jd_id, final_score FROM scores WHERE NOT (final_score BETWEEN 0 AND 100)"""))
def _(t: Tables) -> DataFrame:
    ok = cleaning.scores_in_range("final_score", *DIMENSIONS)
    return t.screening.scores.filter(~ok).select("cv_id", "jd_id", "final_score")


@query("S4_score_export", o.sql(f"""
  SELECT jd_id, row_number() OVER (PARTITION BY jd_id ORDER BY final_score DESC, cv_id) AS row_index, cv_id || '.pdf' AS cv,
    {", ".join(f"{o.fixed(c, 1)} AS {c}" for c in ("final_score", *DIMENSIONS))} FROM scores"""))
def _(t: Tables) -> DataFrame:
    """The ranked table of every job with all six scores, as a tab-separated file with a
    header, read back as text."""
    scores = t.screening.scores.withColumn("cv_url", F.concat(F.lit("https://cv.example.org/"), F.col("cv_id").cast("string"), F.lit(".pdf")))
    table = score_table(scores, ["jd_id"], [F.desc("final_score"), F.asc("cv_id")])
    path = new_folder(t.spark)
    write_score_table(table, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return t.spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
