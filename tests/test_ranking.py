"""Running sums and row numbers of groups that reach over many ranges."""

from pyspark.sql import functions as F

from talentloom.operators import ranking


def test_running_sums_and_numbers(spark):
    rows = [("hot", i % 700, i) for i in range(3000)] + [(None, i, i) for i in range(50)] + [(f"g{i}", i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "grp string, at long, v long")
    order = [F.desc("at"), F.asc("v")]
    got = ranking.running(df, ["grp"], order, {"total": F.col("v"), "place": F.lit(1)}).collect()
    want = {}
    for name in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == name), key=lambda r: (-r[1], r[2])), 1):
            total += r[2]
            want[r] = (total, n)
    assert len(got) == len(rows) and {(r.grp, r.at, r.v): (r.total, r.place) for r in got} == want
    places = ranking.numbered(df, [], [F.asc("v"), F.asc("grp")], "place").collect()
    assert sorted(r.place for r in places) == list(range(1, len(rows) + 1))
    in_order = [(r.v, r.grp or "") for r in sorted(places, key=lambda r: r.place)]
    assert in_order == sorted(in_order)
    same = spark.range(1000).select(F.lit(1).alias("k"))
    assert sorted(r.n for r in ranking.numbered(same, ["k"], [F.asc("k")], "n").collect()) == list(range(1, 1001))
    assert ranking.numbered(df.limit(0), ["grp"], order, "n").count() == 0
