"""Joins between tables that grow do not gather one of them on the driver."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talentloom.session import ADAPTIVE, CLEANUP, FILE_FACTOR, STATIC, broadcast_by_rows, materialise
from talentloom.plans.queries_cleaning import clean_records
from talentloom.sources.tables import Tables, record_json


@pytest.fixture
def folder(spark, tmp_path):
    """Files far below the broadcast threshold, with many rows."""
    names = F.concat(F.lit("new "), (F.col("id") % 8).cast("string"))
    part = spark.range(400_000).select(F.col("id").alias("p_partkey"), names.alias("p_name"), F.lit("b").alias("p_brand"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_small_file_with_many_rows_is_not_broadcast(spark, folder):
    spark.conf.unset(FILE_FACTOR)
    skills = Tables(spark, folder).cv_skills
    assert "BroadcastHashJoin" not in planned(skills)
    assert skills.count() == 4_000_000


def test_a_factor_set_by_the_submitter_stays(spark, folder):
    spark.conf.set(FILE_FACTOR, "4.0")
    try:
        Tables(spark, folder)
        assert spark.conf.get(FILE_FACTOR) == "4.0"
    finally:
        spark.conf.unset(FILE_FACTOR)


def test_records_are_dealt_out_by_rows_and_parsed_before_any_filter(spark, tmp_path):
    rows = [(i, f"n{i}", i % 25, "BUILDING") for i in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    t = Tables(spark, str(tmp_path))
    assert record_json(t).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = clean_records(t)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "parseJson" in line]
    assert records.count() == 192


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {file.name for folder in folders for file in Path(folder).rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    numbers = spark.range(20_000).select("id", (F.col("id") % 1000).alias("k"))
    sums = numbers.join(numbers.groupBy("k").agg(F.sum("id").alias("s")).hint("merge"), "k")
    kept, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    written = materialise(sums)
    deadline = time.time() + 20
    while shuffle_files(spark) - kept and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - kept
    assert spark.conf.get(CLEANUP) == setting
    assert written.count() == sums.count() == 20_000


def test_adaptive_execution_broadcasts_only_what_is_small_in_memory(spark):
    numbers = spark.range(2_000_000).where("id % 20 = 0")  # Spark expects all of them to pass
    rows = numbers.select((F.col("id") % 1_000_000).alias("k"), "id")
    few = rows.where("k % 200 = 0")
    spark.conf.unset(ADAPTIVE), broadcast_by_rows(spark)
    spark.conf.set(STATIC, "10MB")
    try:
        for right, gathered in ((rows, False), (few, True)):
            counts = right.groupBy("k").agg(F.max("id").alias("most"))
            met = rows.join(counts, "k")
            assert "BroadcastHashJoin" not in planned(met)
            met.collect()
            final = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert ("BroadcastHashJoin" in final) == gathered
    finally:
        spark.conf.unset(ADAPTIVE), spark.conf.unset(STATIC)


@pytest.mark.parametrize("own", [(STATIC, "256k"), (ADAPTIVE, "4MB"), (STATIC, "-1")])
def test_a_threshold_set_by_the_submitter_stays(spark, own):
    spark.conf.unset(ADAPTIVE), spark.conf.set(*own)
    try:
        broadcast_by_rows(spark)
        assert spark.conf.get(ADAPTIVE, None) == (own[1] if own[0] == ADAPTIVE else None)
    finally:
        spark.conf.unset(ADAPTIVE), spark.conf.unset(STATIC)
