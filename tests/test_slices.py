"""The plan cut into slices of candidates gives what it gives in one piece."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentloom.operators import evaluation, scoring
from talentloom.plans import properties, screening

SKILLS = ["python", "java", "go", "sql", "node.js", "react", "docker", "Teamwork"]


def plan(spark) -> screening.Screening:
    """23 candidates, one without an id, and 7 jobs; every candidate applies to some of them."""
    cvs = [*range(22), None]
    skill = lambda i, k: SKILLS[((i or 0) * 3 + k * 5) % len(SKILLS)]
    frame = spark.createDataFrame
    return screening.Screening(
        applications=frame([(c, j) for c in cvs for j in range(7) if ((c or 0) + j) % 3], "cv_id long, jd_id long"),
        candidates=frame(
            [(c, (c or 0) % 5, "Hanoi", None, c == 3, None, None, True, f"n{c}") for c in cvs],
            "cv_id long, degree_rank int, city string, raw_address string, willing_to_relocate boolean, lat double, lng double, is_resume boolean, name string",
        ),
        cv_skills=frame([(c, k, skill(c, k)) for c in cvs for k in range(3)], "cv_id long, pos int, skill string"),
        credentials=frame([(c, "Japanese - JLPT N2" if (c or 0) % 2 else None) for c in cvs], "cv_id long, text string"),
        employment=frame([(c, k, 100 + 7 * k, 130 + 9 * k) for c in cvs for k in range(3)], "cv_id long, job_id long, start_m int, end_m int"),
        stacks=frame([(c, k, skill(c, k + 1)) for c in cvs for k in range(3)], "cv_id long, job_id long, skill string"),
        jobs=frame([(j, j % 4, j % 3, "Hanoi", "onsite", None, None) for j in range(7)], "jd_id long, min_years int, degree_rank int, city string, work_mode string, lat double, lng double"),
        requirements=frame(
            [(j, "required" if p < 2 else "preferred", p, a, SKILLS[(j + 2 * p + a) % 8], p % 3 + 1) for j in range(6) for p in range(4) for a in range(2)],
            "jd_id long, tier string, req_pos int, alt_pos int, name string, weight int",
        ),
        aliases=frame([(s, s) for s in SKILLS] + [("nodejs", "node.js")], "alias string, canonical string"),
        implies=frame([("react", "node.js")], "src string, dst string"),
        cv_vectors=frame([(c, [1.0, 0.5 + (c or 0)]) for c in cvs], "cv_id long, embedding array<double>"),
        jd_vectors=frame([(j, [float(j), 1.0]) for j in range(5)], "jd_id long, embedding array<double>"),
        routes=frame([], "lat1 double, lng1 double, lat2 double, lng2 double, duration_min double"),
    )


RESULTS = {
    "scores": lambda s: s.scores,
    "sums": lambda s: s.sums,
    "evidence": lambda s: s.evidence,
    "months": lambda s: s.months,
    "met": lambda s: s.met,
    "skills": lambda s: s.sliced(lambda x: scoring.skill_scores(x.applications, x.evidence), ("index", "hot")),
    "report": lambda s: s.sliced(lambda x: evaluation.skill_report(x.applications, x.evidence), ("index", "hot")),
    "bonus": lambda s: s.sliced(lambda x: evaluation.bonus_skills(x.applications, x.cv_skills, x.requirements, x.aliases), ()),
    "sentences": lambda s: s.sliced(lambda x: evaluation.experience_sentences(x.applications, x.jobs, x.groups, x.months, x.total_months), ("index", "hot")),
}


@pytest.fixture(scope="module")
def whole(spark):
    return plan(spark)


@pytest.fixture(scope="module")
def cut(spark):
    before, screening.SLICE_ROWS = screening.SLICE_ROWS, 400
    yield plan(spark)
    screening.SLICE_ROWS = before


@pytest.mark.parametrize("name", RESULTS)
def test_slices_give_the_same_rows(whole, cut, name):
    # `cut` sets the size of slices, so the number of slices of `whole` is given.
    whole.__dict__.update(slices=1, met_slices=1)
    want = Counter(map(str, RESULTS[name](whole).collect()))
    got = Counter(map(str, RESULTS[name](cut).collect()))
    assert cut.slices > 1 and want and got == want


def test_slices_leave_only_results_behind(cut, monkeypatch):
    assert cut.sums
    written, kept, write = [], len(cut.scratch), screening.materialise

    def recorded(df):
        made = write(df)
        written.extend({file.removeprefix("file:").rsplit("/", 1)[0] for file in made.inputFiles()})
        return made

    monkeypatch.setattr(screening, "materialise", recorded)
    cut.sliced(lambda s: s.sums, ("classes", "hot"))
    left = [folder for folder in written if os.path.isdir(folder)]
    assert len(written) > len(left) == len(cut.scratch) - kept == cut.slices


def test_properties_hold_in_slices(spark, monkeypatch):
    monkeypatch.setattr(screening, "SLICE_ROWS", 400)
    held = spark.range(3).select(F.col("id").alias("cv_id"), F.array(F.struct(F.lit("BSc").alias("degree"))).alias("education"))
    assert {r.kind: r.n for r in properties.broken(plan(spark), held).collect()} == dict.fromkeys(
        ["requirement order matters", "overlap counts twice", "listing counts as months", "education order matters"], 0
    )
