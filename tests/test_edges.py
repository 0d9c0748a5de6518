"""Values and shapes that the tables do not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom import session
from talentloom.functions.cleaning import min_years
from talentloom.operators import evaluation, metrics
from talentloom.sources import records


def test_years_from_odd_text(spark):
    rows = [("3d", 0), ("3f", 0), ("3000000000", 2**31 - 1), ("2.1", 3), (" 4 ", 4), ("-2", 0), ("", 0), (None, 0), ("NaN", 0), ("1e1", 10), (".5", 1)]
    got = spark.createDataFrame([(r[0],) for r in rows], "y string").select(min_years("y").alias("n")).collect()
    assert [r.n for r in got] == [r[1] for r in rows]


def test_constant_column_has_no_rank_correlation(spark):
    df = spark.range(1_000_003).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    bucket = F.floor(F.col("x") / 1000)
    row = metrics.spearman(df, "x", "y", bucket, F.lit(0)).first()
    assert row.rho == 0.0 and row.n == 1_000_003


def test_pair_of_a_job_without_requirements_is_reported(spark):
    pairs = spark.createDataFrame([("c", "j")], "cv_id string, jd_id string")
    names = "cv_id string, jd_id string, req_pos int, label string, tier string, weight int, credit double, status string"
    row = evaluation.skill_report(pairs, spark.createDataFrame([], names)).first()
    assert (row.missing_must_have, row.missing_preferred, row.missing_nice_to_have, row.skill_match_rate) == ("", "", "", 100.0)


def test_cluster_master_needs_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_wrongly_typed_fields_do_not_reject_a_record(spark):
    body = '{"name": 123, "skills": ["a", 3], "education": {}, "work_experience": [{"company": "c", "months": "7"}, 5], "candidate_location": {"lat": "1.5"}}'
    df = spark.createDataFrame([(1, body), (2, '{"name": "x", "skills": "python"}'), (3, "[1]"), (4, None)], "id int, body string")
    rows = {r.id: r for r in records.parse_records(df, "body", records.CANDIDATE_SCHEMA).collect()}
    assert [rows[i].error for i in (1, 2, 3, 4)] == [None, None, "invalid JSON", "invalid JSON"]
    first = rows[1].record
    assert first.name is None and first.skills == ["a"] and first.education is None and first.candidate_location.lat == 1.5
    assert [(j.company, j.months) for j in first.work_experience] == [("c", 7)] and rows[2].record.skills is None


def test_blank_required_skill_keeps_its_weight(spark):
    body = '{"required_skills": [{"skill": "", "weight": 2}, {"skill": "go", "alternatives": "x"}], "min_experience_years": "2.1", "preferred_skills": "x"}'
    parsed = records.parse_records(spark.createDataFrame([("j", body)], "jd_id string, body string"), "body", records.JOB_SCHEMA)
    jobs = records.normalise_jobs(parsed.select("jd_id", "record.*"))
    rows = records.flat_requirements(jobs).collect()
    assert sorted((r.req_pos, r.name, r.weight) for r in rows) == [(0, "", 2), (1, "go", 3)]
    assert jobs.first().min_experience_years == 3 and jobs.first().preferred_skills == []


def test_pair_statistics_cover_all_pairs(spark):
    source = np.random.default_rng(3)
    x, labels = source.normal(size=(60, 8)), source.integers(0, 4, 60)
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    x[41], labels[41] = x[2], labels[2] + 1  # the nearest pair across labels is no pair of neighbours
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    rows += [(60, None, 1), (61, x[0].tolist(), None), (62, [1.0] * 3, 1), (5, x[5].tolist(), int(labels[5]))]
    units = spark.createDataFrame(rows, "vec_id long, unit array<double>, label int")
    pairs = [(i, j) for i in [*range(60), 5] for j in [*range(60), 5] if i < j]
    within = [round(float(x[i] @ x[j]), 6) for i, j in pairs if labels[i] == labels[j]]
    cross = [round(float(x[i] @ x[j]), 6) for i, j in pairs if labels[i] != labels[j]]
    for rows_of_a_block in (7, 4096):
        got = metrics.pair_statistics(units, "vec_id", "label", rows_of_a_block).first()
        assert (got.within_min, got.within_max, got.cross_min, got.cross_max) == (min(within), max(within), min(cross), max(cross))
        assert got.cross_max == 1.0 and got.above == sum(c > max(cross) for c in within)
        assert abs(got.within_mean - np.mean(within)) < 2e-6 and abs(got.cross_mean - np.mean(cross)) < 2e-6
    empty = metrics.pair_statistics(units.limit(0), "vec_id", "label").first()
    assert empty.cross_max is None and empty.above == 0


def test_pairs_are_cut_into_no_more_blocks_than_tasks_and_memory_ask_for():
    assert metrics.pair_blocks(2_000, 64, 200, 4096) == 1
    assert metrics.pair_blocks(40_000, 64, 200, 4096) == 10
    assert metrics.pair_blocks(650_000, 64, 200, 4096) == 20  # 159 blocks of 4096 send eight times as much
    assert metrics.pair_blocks(650_000, 8_192, 200, 4096) == 159
    assert metrics.pair_blocks(0, 0, 200, 4096) == 1
