"""Stored tables and the published knowledge base: versions, interruptions, refusals."""

import pytest
from pyspark.sql import functions as F

from talentloom.operators import knowledge
from talentloom.sources.knowledge_files import KnowledgeBase, MergeRefused, load_edges
from talentloom.sources.versions import VersionedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("kind"), F.lit(1.0).alias("score"))
    made = VersionedTable(spark, str(tmp_path / "scores"), df.schema, ["id"], buckets=8)
    made.create(df)
    return made


def test_upsert_rewrites_only_the_buckets_it_touches(spark, table):
    before = {e.bucket: e.folder for e in table._entries()}
    fresh = spark.createDataFrame([(3, 0, 9.0), (500, 1, 8.0)], table.schema)
    table.upsert(fresh)
    got = {r.id: r.score for r in table.read().collect()}
    assert got == {**{i: 1.0 for i in range(200)}, 3: 9.0, 500: 8.0}
    after = {e.bucket: e.folder for e in table._entries()}
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert rows(table.read(1)) == [(i, i % 7, 1.0) for i in range(200)]
    plan = table.read()._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_interrupted_change_leaves_the_old_version(spark, table, monkeypatch):
    old = rows(table.read())

    def die(*_args, **_more):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(table, "_publish", die)
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame([(3, 0, 9.0)], table.schema))
    assert table.version() == 1 and rows(table.read()) == old
    broken = spark.createDataFrame([(3, 0, 9.0)], table.schema).withColumn("score", F.raise_error(F.lit("bad row")).cast("double"))
    with pytest.raises(Exception, match="bad row"):
        table.upsert(broken)
    assert rows(table.read()) == old
    table.upsert(spark.createDataFrame([(3, 0, 9.0)], table.schema))
    assert table.version() == 2 and {r.id: r.score for r in table.read().collect()}[3] == 9.0


def test_delete_empty_and_repeated_rows(spark, table):
    table.delete(spark.createDataFrame([(3,), (3,), (77,)], "kind long"), ["kind"])
    assert rows(table.read()) == [(i, i % 7, 1.0) for i in range(200) if i % 7 != 3]
    table.upsert(table.read().limit(0))
    table.delete(spark.createDataFrame([], "kind long"), ["kind"])
    assert table.version() == 2
    table.upsert(spark.createDataFrame([(None, 1, 2.0), (None, 1, 2.0)], table.schema))
    assert table.read().where("id is null").count() == 2
    table.replace(table.read().limit(0))
    assert table.read().isEmpty() and table.read().schema == table.schema
    with pytest.raises(ValueError, match="_bucket"):
        VersionedTable(spark, "unused", spark.range(1).withColumnRenamed("id", "_bucket").schema, ["_bucket"])


def knowledge_base(spark, path):
    base = KnowledgeBase(spark, path)
    aliases = spark.createDataFrame([("py", "python"), ("python", None), ('od"d\\ name', None), ("sql", "sql")], "alias string, canonical string")
    base.publish(aliases, spark.createDataFrame([("python", "sql", 1), ("python", 'od"d\\ name', 0)], "src string, dst string, pos long"))
    return base


def test_knowledge_base_grows_in_given_order(spark, tmp_path):
    base = knowledge_base(spark, str(tmp_path))
    assert rows(base.aliases().where("canonical is null").select("alias")) == [('od"d\\ name',), ("python",)]
    new = spark.createDataFrame([("go",)], "skill string")
    aliases = spark.createDataFrame([("golang", "go"), ("sql", "go")], "alias string, canonical string")
    edges = spark.createDataFrame([("python", "go", 5), ("python", "sql", 0), ("go", "sql", 7)], "src string, dst string, pos long")
    base.merge(new, aliases, edges)
    assert base.version() == 2 and rows(base.edges(1).where("src = 'python'")) == [("python", 'od"d\\ name', 0), ("python", "sql", 1)]
    assert rows(base.edges()) == [("go", "sql", 0), ("python", "go", 2), ("python", 'od"d\\ name', 0), ("python", "sql", 1), ("sql", "go", 0)]
    assert {tuple(r) for r in base.aliases().collect()} >= {("golang", "go"), ("go", None), ("sql", "sql")}


def test_bad_merge_is_refused_whole(spark, tmp_path):
    base = knowledge_base(spark, str(tmp_path))
    none = spark.createDataFrame([], "skill string")
    aliases = spark.createDataFrame([("golang", "go")], "alias string, canonical string")
    edges = spark.createDataFrame([("python", "rust", 0), ("python", "sql", 0)], "src string, dst string, pos long")
    with pytest.raises(MergeRefused) as refused:
        base.merge(none, aliases, edges)
    assert rows(refused.value.violations) == [("alias target", "go"), ("edge target", "rust")]
    assert base.version() == 1 and base.aliases().count() == 4
    with pytest.raises(MergeRefused, match="repeated alias"):
        base.publish(base.aliases().union(base.aliases().limit(1)), base.edges(), 2)
    assert base.version() == 1


def test_one_map_in_a_json_file(spark, tmp_path):
    (tmp_path / "implies.json").write_text('{\n "a": ["z", "b"],\n "b": []\n}')
    assert rows(load_edges(spark, str(tmp_path / "implies.json"))) == [("a", "b", 1), ("a", "z", 0)]


def brute(edges):
    reach = {e for e in edges if e[0] != e[1]}
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c and a != d} - reach
        if not more:
            return reach
        reach |= more


def test_closure_of_a_chain_and_its_extension(spark):
    schema = "src string, dst string"
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    ring = [("x", "y"), ("y", "z"), ("z", "x"), ("z", "z"), ("x", "y")]
    got = knowledge.transitive_closure(spark.createDataFrame(chain + ring, schema))
    assert sorted(map(tuple, got.collect())) == sorted(brute(chain + ring))
    assert knowledge.transitive_closure(spark.createDataFrame([], schema)).isEmpty()
    old, new = chain[:20] + chain[21:40] + ring, [chain[20], ("z", "n010"), ("n039", "y"), ("n001", "n002"), ("q", "q")]
    closed = spark.createDataFrame(sorted(brute(old)), schema)
    grown = knowledge.extend_closure(closed, spark.createDataFrame(new, schema))
    assert sorted(map(tuple, grown.collect())) == sorted(brute(old + new))
