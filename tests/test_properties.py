"""Every property check finds nothing as the operators stand, and something once one is broken."""

import pytest
from pyspark.sql import functions as F

from talentloom.operators import matching, variants
from talentloom.plans import properties, screening
from talentloom.plans.screening import Screening


@pytest.fixture
def small(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    stacks = [(1, 1, "python"), (1, 2, "sql"), (1, 3, "python"), (2, 4, "sql")]
    asked = [(7, "required", 0, 0, "python", 3), (7, "required", 1, 0, "sql", 1), (7, "preferred", 100, 0, "go", 1)]
    return Screening(
        applications=df([(1, 7), (2, 7)], "cv_id long, jd_id long"), candidates=None,
        cv_skills=df([(1, 0, "go"), (2, 0, "python")], "cv_id long, pos int, skill string"),
        credentials=df([], "cv_id long, text string"),
        employment=df([(1, 1, 10, 20), (1, 2, 15, 25), (1, 3, 18, 30), (2, 4, 0, 9)], "cv_id long, job_id long, start_m int, end_m int"),
        stacks=df(stacks, "cv_id long, job_id long, skill string"),
        jobs=df([(7, 5)], "jd_id long, min_years int"),
        requirements=df(asked, "jd_id long, tier string, req_pos int, alt_pos int, name string, weight int"),
        aliases=df([("python", None), ("sql", None), ("go", None)], "alias string, canonical string"),
        implies=df([], "src string, dst string"), cv_vectors=None, jd_vectors=None, routes=None,
    )


def held(spark):
    return spark.createDataFrame([(1, [("bachelor",), ("master",)]), (2, []), (3, None)], "cv_id long, education array<struct<degree:string>>")


def test_nothing_is_broken(spark, small):
    assert {r.kind: r.n for r in properties.broken(small, held(spark)).collect()} == {
        "requirement order matters": 0, "overlap counts twice": 0, "listing counts as months": 0, "education order matters": 0,
    }


def test_weight_by_position_is_found(small, monkeypatch):
    groups = matching.requirement_groups
    monkeypatch.setattr(matching, "requirement_groups", lambda names: groups(names).withColumn("weight", F.col("weight") + F.col("req_pos")))
    assert properties.differing(properties.weighed(small), properties.weighed(properties.reordered_requirements(small))).first().n > 0


def test_months_counted_twice_are_found(small, monkeypatch):
    def naive(spans, keys, out="months"):
        return spans.groupBy(*keys).agg(F.sum(F.col("end_m") - F.col("start_m")).cast("bigint").alias(out))

    monkeypatch.setattr(screening, "merged_months", naive)
    assert properties.differing(properties.covered(small), properties.covered(properties.overlapping_spells(small))).first().n > 0


def test_months_for_listed_skills_are_found(small, monkeypatch):
    met = matching.met_classes

    def generous(listed, used, index, hot):
        given = listed.select("cv_id", "token", F.lit(0).alias("start_m"), F.lit(5).alias("end_m"))
        return met(listed, used.unionByName(given.select(*used.columns)), index, hot)

    monkeypatch.setattr(matching, "met_classes", generous)
    assert properties.differing(properties.covered(small), properties.covered(properties.listed_stacks(small))).first().n > 0


def test_first_degree_instead_of_highest_is_found(spark, monkeypatch):
    def first(education):
        return F.try_element_at(education, F.lit(1))["degree"]

    monkeypatch.setattr(properties, "highest_degree_rank", first)
    assert properties.differing(properties.degrees(held(spark)), properties.degrees(held(spark), turned=True)).first().n == 2


def test_differing_counts_repeats_and_nulls(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    other = spark.createDataFrame([(1, None), (2, "y")], "a int, b string")
    assert properties.differing(one, other).first().n == 3 and properties.differing(one, one).first().n == 0


def test_rewrites_and_filling(spark):
    base = spark.createDataFrame([("node.js tool", "p"), ("élan-x 3d", "q"), ("", "r")], "name string, parent string")
    got = {r.name: (r.origin, r.parent) for r in variants.all_variants(base, "name").collect()}
    assert "node-js-tool" not in got
    for name in ("node.js-tool", "nodejs tool", "NODE.JS TOOL", "Node.Js Tool", "NODE.JS-TOOL", "node.js_tool"):
        assert got[name] == ("variant", "p")
    assert got["Élan-X 3D"] == ("variant", "q") and got["élan x 3d"] == ("variant", "q") and got[""] == ("written", "r")
    every = variants.all_variants(base, "name", 43).where("origin = 'variant'").orderBy("fill_order").collect()
    for digits in (1, 4):
        for target in (3, 5, 9, 3 + len(every), 100):
            rows = variants.filled(base, "name", target, 43, digits).collect()
            want = [r.name for r in every[: target - 3]]
            assert sorted(r.name for r in rows if r.origin == "variant") == sorted(want) and len(rows) == 3 + len(want)
        assert variants.filled(base, "name", 2, 43, digits).count() == 2
        assert variants.filled(base, "name", 0, 43, digits).count() == 0
    assert variants.filled(base.limit(0), "name", 5).count() == 0


def test_changed_plans_share_what_does_not_derive_from_the_change(small, spark):
    assert all(f(small).pairs is small.pairs for f in (properties.reordered_requirements, properties.overlapping_spells, properties.listed_stacks))
    assert properties.overlapping_spells(small).index is small.index
    properties.broken(small, held(spark))
    assert any("talentloom-" in file for file in small.sums.inputFiles())  # written once, read by three checks
