"""Streams restarted on the same path: nothing twice, nothing lost."""

import json

from pyspark.sql import functions as F

from talentloom.operators import matching
from talentloom.streaming import scoring_stream, skill_log


def cv(key, *jobs, **more):
    return json.dumps({"cv_id": key, "jd_ids": jobs, "embedding": [1.0, 0.0], "name": f"n{key}", "skills": ["Python"],
                       "work_experience": [{"company": "C", "start": "2020-01", "end": "2022-01", "tech_stack": ["python"]}], **more})


def test_scoring_of_arriving_records(spark, tmp_path):
    aliases = spark.createDataFrame([("python", None), ("java", None)], "alias string, canonical string")
    none = "lat double, lng double"
    side = scoring_stream.JobSide(
        jobs=spark.createDataFrame([(1, 2, 0, "Ha Noi", "remote", None, None), (2, 0, 3, "Ha Noi", "remote", None, None)],
                                   f"jd_id long, min_years int, degree_rank int, city string, work_mode string, {none}"),
        requirements=spark.createDataFrame([(1, "required", 0, 0, "python", 3), (2, "required", 0, 0, "java", 3)],
                                           "jd_id long, tier string, req_pos int, alt_pos int, name string, weight int"),
        aliases=aliases,
        implies=spark.createDataFrame([], "src string, dst string"),
        jd_vectors=spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "jd_id long, embedding array<float>"),
        routes=spark.createDataFrame([], "lat1 double, lng1 double, lat2 double, lng2 double, duration_min double"),
        gazetteer=spark.createDataFrame([], f"address string, {none}"),
    ).written()
    folder, path = tmp_path / "lines", str(tmp_path / "stream")
    folder.mkdir()

    def arrive(name, *lines):
        (folder / name).write_text("\n".join(lines) + "\n")
        scoring_stream.score_arrivals(scoring_stream.line_stream(spark, str(folder)), side, "2024-06", path)
        return sorted(map(tuple, spark.read.parquet(f"{path}/scores").select("cv_id", "jd_id", "final_score").collect()))

    first = arrive("a.txt", cv(10, 1, 2), cv(10, 1, 2), cv(11, 2)[:-4], cv(12, 1, is_resume=False), '{"name": "no id"}', "")
    # All met: 100; and for the other job only the location, years and half of the degree.
    assert first == [(10, 1, 100.0), (10, 2, 35.0)]
    assert arrive("b.txt", cv(11, 2).replace(":", "", 1), cv(13, 1)[:-1] + ",}") == sorted([*first, (13, 1, 100.0)])
    scoring_stream.score_arrivals(scoring_stream.line_stream(spark, str(folder)), side, "2024-06", path)
    assert spark.read.parquet(f"{path}/scores").count() == 3
    bad = [r.error for r in spark.read.parquet(f"{path}/quarantine").collect()]
    assert sorted(bad) == ["invalid JSON"] * 3 + ["no cv_id", "not a resume"]


def test_unknown_skill_log_equals_the_batch(spark, tmp_path):
    aliases = spark.createDataFrame([("python", None), ("node.js", "nodejs"), ("nodejs", None)], "alias string, canonical string")
    tokens = ["python", "pythonn", "node js", "zig", "zig", "elm", "jlpt n2", "  ", "hot"]
    rows = [(t, f"cv{i % 5}", f"2024-01-{i % 28 + 1:02d}") for i in range(90) for t in tokens[i % 7 :]] + [("hot", f"cv{i}", "2024-02-01") for i in range(300)]
    folder, path = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "token string, cv_name string, seen_on string"
    for part in (rows[:100], rows[100:400], rows[400:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        skill_log.run_log(spark.readStream.schema(schema).parquet(folder), aliases, path=path)
    got = skill_log.read_log(spark.read.parquet(f"{path}/rows"), aliases).collect()
    df = spark.createDataFrame(rows, schema)
    ids = df.select(F.concat_ws("|", "cv_name", "seen_on").alias("cv_id"), "cv_name", "seen_on").distinct()
    batch = matching.unknown_skills(df.select("token", F.concat_ws("|", "cv_name", "seen_on").alias("cv_id")).distinct(), aliases, ids).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and {r.skill for r in got} == {"zig", "elm", "hot"}
