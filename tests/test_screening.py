"""Golden cases on nested records, through the same plan the tables use."""

import json

import pytest
from pyspark.sql import functions as F

from talentloom.operators import evaluation, intervals, knowledge
from talentloom.plans.screening import Screening
from talentloom.sources import records

AS_OF = "2024-06"


def month(text):
    y, m = text.split("-")
    return int(y) * 12 + int(m) - 1


def job(start, end, *stack):
    return {"company": "C", "role": "Dev", "start": start, "end": end, "tech_stack": list(stack)}


CVS = {
    "depth": {
        "name": "A", "skills": ["Python", "SQL"], "languages": ["Japanese - JLPT N2"],
        "work_experience": [
            job("2018-01", "2019-01", "python"), job("2018-07", "2019-07", "Python"),
            job("2019-06", "2020-06", "python"), job("2021-01", "2022-01", "java"),
        ],
        "education": [{"institution": "U", "degree": "BSc"}],
        "candidate_location": {"city": "Hanoi"},
    },
    "empty": {"name": "B", "is_resume": True},
}
JDS = {
    "dev": {
        "title": "Dev", "min_experience_years": "2",
        "required_skills": [
            {"skill": "python3", "weight": 3, "alternatives": ["java"]}, {"skill": "JLPT N3", "weight": 2},
            {"skill": "Postgresql", "weight": 1}, {"skill": "Teamwork"},
        ],
        "preferred_skills": ["SQL"], "nice_to_have_skills": ["programming-language"],
        "education_degree": "master", "work_location": {"city": "hn"},
    },
    "open": {"title": "Any", "education_degree": "null", "work_location": {"work_mode": "Remote"}},
}


@pytest.fixture(scope="module")
def screening(spark):
    def read(rows, key, schema):
        df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], f"{key} string, body string")
        return records.parse_records(df, "body", schema).filter("error is null").select(key, "record.*")

    cv = records.normalise_candidates(read(CVS, "cv_id", records.CANDIDATE_SCHEMA), AS_OF)
    jd = records.normalise_jobs(read(JDS, "jd_id", records.JOB_SCHEMA))
    start, end = (F.col("start"), F.col("end"))
    from talentloom.functions.cleaning import degree_rank
    from talentloom.functions.months import span

    s, e = span(start, end, AS_OF)
    place = "candidate_location"
    aliases = spark.createDataFrame(
        [("python", None), ("python3", "python"), ("java", None), ("sql", None), ("programming-language", None)],
        "alias string, canonical string",
    )
    edges = spark.createDataFrame([("python", "programming-language")], "src string, dst string")
    vectors = spark.createDataFrame([], "cv_id string, embedding array<float>")
    return Screening(
        applications=cv.select("cv_id").join(jd.select("jd_id"), F.lit(True)),
        candidates=cv.select(
            "cv_id", records.highest_degree_rank("education").alias("degree_rank"), f"{place}.city",
            f"{place}.raw_address", f"{place}.willing_to_relocate", f"{place}.lat", f"{place}.lng",
        ),
        cv_skills=records.flat_skills(cv),
        credentials=records.flat_credentials(cv),
        employment=records.flat_employment(cv).select("cv_id", "job_id", s.alias("start_m"), e.alias("end_m")),
        stacks=records.flat_stacks(cv),
        jobs=jd.select(
            "jd_id", F.col("min_experience_years").alias("min_years"), degree_rank("education_degree").alias("degree_rank"),
            "work_location.city", "work_location.work_mode", "work_location.lat", "work_location.lng",
        ),
        requirements=records.flat_requirements(jd),
        aliases=aliases,
        implies=edges,
        cv_vectors=vectors,
        jd_vectors=vectors.withColumnRenamed("cv_id", "jd_id"),
        routes=spark.createDataFrame([], "lat1 double, lng1 double, lat2 double, lng2 double, duration_min double"),
    )


def test_evidence_layers(screening):
    rows = screening.evidence.filter("cv_id = 'depth'").collect()
    got = {r["label"]: (r["status"], r["matched_layer"], r["matched_via"]) for r in rows}
    assert got == {
        "python3 / java": ("matched", "layer0", "java"),
        "JLPT N3": ("matched", "proficiency", "japanese - jlpt n2"),  # ties: smaller token
        "Postgresql": ("missing", "missing", ""),
        "SQL": ("matched", "layer0", "sql"),
        "programming-language": ("matched_implied", "layer2", "python"),
    }


def test_dimensions(screening):
    got = {(r["cv_id"], r["jd_id"]): r for r in screening.dimensions.collect()}
    dev = got["depth", "dev"]
    assert dev["semantic"] == 0.5
    assert dev["skills"] == pytest.approx(8 / 9)
    # python 29 months and java 12 more: 41 of 24 needed; JLPT and Postgresql have no months.
    assert dev["experience"] == pytest.approx((3 / 6 + 1) / 2)
    assert dev["education"] == pytest.approx(3 / 4)
    assert dev["location"] == 0.5
    open_job = got["depth", "open"]
    assert [open_job[d] for d in ("skills", "experience", "education", "location")] == [1, 1, 1, 1]
    nobody = got["empty", "dev"]
    assert (nobody["skills"], nobody["experience"], nobody["education"], nobody["location"]) == (0, 0, 0.5, 0.5)


def test_months_agree_with_the_combined_plan(screening):
    months = {(r["cv_id"], r["req_pos"]): r["months"] for r in screening.months.collect()}
    assert months == {("depth", 0): 41}


def test_report(screening):
    row = evaluation.skill_report(screening.applications, screening.evidence).filter("cv_id = 'depth' and jd_id = 'dev'").first()
    assert (row["missing_must_have"], row["missing_preferred"], row["skill_match_rate"]) == ("", "Postgresql", 88.9)
    bonus = evaluation.bonus_skills(
        screening.applications, screening.cv_skills, screening.requirements, screening.aliases
    ).collect()
    assert [tuple(r) for r in bonus] == [("depth", "open", "Python, SQL")]


@pytest.mark.parametrize(
    "spans, months",
    [
        ([("2018-01", "2019-01"), ("2018-07", "2019-07"), ("2019-06", "2020-06")], 29),
        ([("2020-01", "2021-01"), ("2021-01", "2022-01")], 24),
        ([("2020-01", "2021-01"), ("2021-02", "2022-02")], 24),
        ([("2020-01", "2022-01"), ("2020-03", "2020-05"), ("2020-01", "2020-02")], 24),
    ],
)
def test_merged_months(spark, spans, months):
    for order in (spans, spans[::-1]):
        df = spark.createDataFrame([(1, month(a), month(b)) for a, b in order], "k int, start_m int, end_m int")
        assert intervals.merged_months(df, ["k"]).first()["months"] == months
        merged = intervals.merged_spans(df, ["k"]).first()
        assert merged["months"] == months == sum(s["e"] - s["s"] for s in merged["spans"])


def test_spans_ignore_rows_without_a_start(spark):
    df = spark.createDataFrame([(1, None, 500), (1, 100, 110), (2, None, None)], "k int, start_m int, end_m int")
    got = {r["k"]: r["months"] for r in intervals.merged_spans(df, ["k"]).collect()}
    assert got == {1: 10, 2: 0}


def test_closure_handles_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {tuple(r) for r in knowledge.transitive_closure(edges).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd" if x != y}


def test_bad_records_are_kept_apart(spark):
    df = spark.createDataFrame(
        [(1, '{"name": "x",}'), (2, '{"name": '), (3, '{"name": "y"}'), (4, "no")], "id int, body string"
    )
    rows = {r["id"]: r for r in records.parse_records(df, "body", records.CANDIDATE_SCHEMA).collect()}
    assert [rows[i]["error"] for i in (1, 2, 3, 4)] == [None, "invalid JSON", None, "invalid JSON"]
    assert rows[1]["repaired"] and rows[1]["record"]["name"] == "x" and not rows[3]["repaired"]
