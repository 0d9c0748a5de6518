"""The layered match and everything read off its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.operators import evaluation, matching
from talentloom.operators.metrics import compound_risk
from talentloom.plans import oracle as o
from talentloom.plans.registry import query
from talentloom.plans.screening import Screening
from talentloom.session import salted_join
from talentloom.sources.tables import Tables


def _big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query(
    "J1_J2_J3_J5_J6_met_names",
    o.sql("SELECT cv_id, name, layer::BIGINT AS layer, via, credit FROM met"),
)
def _(t: Tables) -> DataFrame:
    """Per candidate and required name: the first layer that meets it."""
    return _big(t.screening.met, "layer")


@query(
    "J4_proficiency_join",
    o.sql("SELECT cv_id, name, via, credit FROM met WHERE layer = 4"),
)
def _(t: Tables) -> DataFrame:
    return t.screening.met.filter("layer = 4").select("cv_id", "name", "via", "credit")


@query(
    "J7_J8_J9_evidence",
    o.sql("""
      SELECT cv_id, jd_id, tier, req_pos::BIGINT AS req_pos, label, weight::BIGINT AS weight, status, matched_layer, matched_via, credit
      FROM evidence"""),
)
def _(t: Tables) -> DataFrame:
    return _big(t.screening.evidence, "req_pos", "weight")


@query("J10_pair_expansion", o.sql("SELECT cv_id, jd_id FROM applications"))
def _(t: Tables) -> DataFrame:
    return t.applications


_STATUS = """CASE WHEN status <> 'missing' THEN status WHEN tier = 'nice_to_have' THEN 'missing_nice_to_have'
  WHEN tier = 'preferred' OR weight < 3 THEN 'missing_preferred' ELSE 'missing_must_have' END"""


@query(
    "E1_requirement_status",
    o.sql(f"SELECT cv_id, jd_id, req_pos::BIGINT AS req_pos, {_STATUS} AS status FROM evidence"),
)
def _(t: Tables) -> DataFrame:
    position = F.col("req_pos").cast("bigint").alias("req_pos")
    return t.screening.sliced(
        lambda s: s.evidence.select("cv_id", "jd_id", position, evaluation.requirement_status().alias("status")), ("index", "hot")
    )


def _missing(status: str) -> str:
    return f"coalesce(string_agg(label, ', ' ORDER BY req_pos) FILTER (detail = '{status}'), '') AS {status}"


_REPORT = f"""
  SELECT cv_id, jd_id, {_missing('missing_must_have')}, {_missing('missing_preferred')}, {_missing('missing_nice_to_have')},
    CASE WHEN sum(weight) > 0 THEN {o.half_even('sum(weight * credit) / sum(weight) * 100', 1)} ELSE 100.0 END AS skill_match_rate
  FROM (SELECT a.cv_id, a.jd_id, e.req_pos, e.label, e.weight, e.credit, e.detail FROM applications a
    LEFT JOIN (SELECT *, {_STATUS} AS detail FROM evidence) e ON e.cv_id = a.cv_id AND e.jd_id = a.jd_id)
  GROUP BY cv_id, jd_id"""


@query("E2_E3_skill_report", o.sql(_REPORT))
def _(t: Tables) -> DataFrame:
    return t.screening.sliced(lambda s: evaluation.skill_report(s.applications, s.evidence), ("index", "hot"))


_BONUS = """
  SELECT cv_id, jd_id, string_agg(skill, ', ' ORDER BY pos) AS bonus_skills FROM (
    SELECT a.cv_id, a.jd_id, s.pos, s.skill FROM applications a JOIN cv_skills s ON s.cv_id = a.cv_id
    JOIN resolved r ON r.name = s.skill
    LEFT JOIN (SELECT DISTINCT q.jd_id, x.canonical FROM requirements q JOIN resolved x ON x.name = q.name) w
      ON w.jd_id = a.jd_id AND w.canonical = r.canonical
    WHERE w.jd_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY a.cv_id, a.jd_id ORDER BY s.pos) <= 8)
  GROUP BY cv_id, jd_id"""


@query("J18_bonus_skills", o.sql(_BONUS))
def _(t: Tables) -> DataFrame:
    return t.screening.sliced(bonuses, ())


_SENTENCE = f"""
  SELECT a.cv_id, a.jd_id, CASE WHEN j.min_years = 0 THEN 'JD không yêu cầu số năm kinh nghiệm cụ thể'
    ELSE 'CV có ' || concat_ws(', ', p.parts, 'thâm niên ' || {o.fixed('coalesce(t.total_months, 0) / 12.0::DOUBLE', 1)} || ' năm')
      || ', JD yêu cầu ' || j.min_years || ' năm' END AS experience_detail
  FROM applications a JOIN jobs j ON j.jd_id = a.jd_id LEFT JOIN total_months t ON t.cv_id = a.cv_id
  LEFT JOIN (
    SELECT m.cv_id, m.jd_id, string_agg({o.fixed('m.months / 12.0::DOUBLE', 1)} || ' năm kinh nghiệm ' || g.label, ', ' ORDER BY g.req_pos) AS parts
    FROM group_months m JOIN groups g ON g.jd_id = m.jd_id AND g.req_pos = m.req_pos WHERE m.months > 0
    GROUP BY m.cv_id, m.jd_id) p ON p.cv_id = a.cv_id AND p.jd_id = a.jd_id"""


def bonuses(s: Screening) -> DataFrame:
    return evaluation.bonus_skills(s.applications, s.cv_skills, s.requirements, s.aliases)


def sentences(s: Screening) -> DataFrame:
    return evaluation.experience_sentences(s.applications, s.jobs, s.groups, s.months, s.total_months)


@query("E4_experience_sentence", o.sql(_SENTENCE))
def _(t: Tables) -> DataFrame:
    return t.screening.sliced(sentences, ("index", "hot"))


_VERDICT = """CASE WHEN j.degree_rank = 0 THEN 'not_required' WHEN c.degree_rank > j.degree_rank THEN 'exceeds'
  WHEN c.degree_rank = j.degree_rank THEN 'meets' ELSE 'below' END"""


def ranks(t: Tables | Screening) -> DataFrame:
    """(cv_id, jd_id, cv_rank, jd_rank) of every application."""
    jd = t.jobs.select("jd_id", F.col("degree_rank").alias("jd_rank"))
    cv = t.candidates.select("cv_id", F.col("degree_rank").alias("cv_rank"))
    return salted_join(t.applications, jd, ["jd_id"], ["cv_id"]).join(cv, "cv_id")


@query(
    "E5_education_verdict",
    o.sql(f"""
      SELECT a.cv_id, a.jd_id, {_VERDICT} AS verdict
      FROM applications a JOIN candidates c ON c.cv_id = a.cv_id JOIN jobs j ON j.jd_id = a.jd_id"""),
)
def _(t: Tables) -> DataFrame:
    return ranks(t).select("cv_id", "jd_id", evaluation.education_verdict("cv_rank", "jd_rank").alias("verdict"))


@query(
    "E7_full_evaluation",
    o.sql(f"""
      SELECT a.cv_id, a.jd_id, r.missing_must_have, r.missing_preferred, r.missing_nice_to_have, r.skill_match_rate,
        coalesce(b.bonus_skills, '') AS bonus_skills, s.experience_detail, {_VERDICT} AS education_verdict,
        c.is_resume AND (coalesce(c.name, '') <> '' OR c.cv_id IN (SELECT cv_id FROM cv_skills)) AS is_valid_cv
      FROM applications a JOIN candidates c ON c.cv_id = a.cv_id JOIN jobs j ON j.jd_id = a.jd_id
      JOIN ({_REPORT}) r ON r.cv_id = a.cv_id AND r.jd_id = a.jd_id
      JOIN ({_SENTENCE}) s ON s.cv_id = a.cv_id AND s.jd_id = a.jd_id
      LEFT JOIN ({_BONUS}) b ON b.cv_id = a.cv_id AND b.jd_id = a.jd_id"""),
)
def _(t: Tables) -> DataFrame:
    pair = ["cv_id", "jd_id"]

    def evaluated(s: Screening) -> DataFrame:
        listed = s.cv_skills.groupBy("cv_id").agg(F.count("*").alias("n_skills"))
        is_valid = evaluation.is_valid_candidate(F.col("is_resume"), F.col("name"), F.col("n_skills"))
        valid = s.candidates.join(listed, "cv_id", "left").select("cv_id", is_valid.alias("is_valid_cv"))
        verdict = evaluation.education_verdict("cv_rank", "jd_rank").alias("education_verdict")
        return (
            ranks(s)
            .select(*pair, verdict)
            .join(valid, "cv_id")
            .join(evaluation.skill_report(s.applications, s.evidence), pair)
            .join(sentences(s), pair)
            .join(bonuses(s), pair, "left")
            .withColumn("bonus_skills", F.coalesce("bonus_skills", F.lit("")))
        )

    return t.screening.sliced(evaluated, ("index", "hot"))


@query(
    "A20_compound_risk",
    o.sql("""
      SELECT tier, p, k, round(1 - pow(1 - p, k), 9) AS risk FROM (
        SELECT tier, round(count(*) FILTER (status = 'missing') / count(*), 9) AS p, unnest(range(1, 11)) AS k
        FROM evidence GROUP BY tier)"""),
)
def _(t: Tables) -> DataFrame:
    missed = F.sum((F.col("status") == "missing").cast("bigint")).alias("missed")
    counts = t.screening.sliced(lambda s: s.evidence.groupBy("tier").agg(missed, F.count("*").alias("n")), ("index", "hot"))
    misses = counts.groupBy("tier").agg(F.round(F.sum("missed") / F.sum("n"), 9).alias("p"))
    return _big(compound_risk(misses, ["tier"], "p"), "k")


@query(
    "J20_exclusive_pickers",
    o.sql("""
      SELECT jd_id, tier, name FROM (
        SELECT DISTINCT r.jd_id, r.tier, r.name FROM raw_requirements r)
      QUALIFY count(*) OVER (PARTITION BY jd_id, name) = 1"""),
)
def _(t: Tables) -> DataFrame:
    """Names offered in one tier of a job and chosen in no other."""
    chosen = t.raw_requirements.select("jd_id", "tier", "name").distinct()
    tiers = chosen.groupBy("jd_id", "name").agg(F.count("*").alias("n"))
    taken = tiers.filter("n > 1").select("jd_id", "name")
    return chosen.join(taken, ["jd_id", "name"], "left_anti").select("jd_id", "tier", "name")
