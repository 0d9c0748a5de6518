"""The knowledge base as JSON maps in files, published in versions behind a gate.

A file holds one map, or a folder holds lines of maps. Alias maps are {alias: canonical or
null}; edge maps are {source: [targets]}, where the order of the targets is given. A
source has its targets in one array, as the format asks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.operators import knowledge
from talentloom.session import materialise


def aliases_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """{alias: canonical or null} objects, one per row, to kb_alias rows."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    return lines.select(F.explode(entries).alias("e")).select(
        F.col("e.key").alias("alias"), F.col("e.value").alias("canonical")
    )


def edges_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """{source: [targets]} objects, one per row, to kb_implies rows with their position."""
    entries = F.map_entries(F.from_json(column, "map<string,array<string>>"))
    return (
        lines.select(F.explode(entries).alias("e"))
        .select(F.col("e.key").alias("src"), F.posexplode("e.value").alias("pos", "dst"))
        .select("src", "dst", F.col("pos").cast("bigint").alias("pos"))
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=path.endswith(".json"))


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) of a .json file with one map, or of a folder with a map per line."""
    return aliases_from_json(_lines(spark, path))


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, pos), as `load_aliases`."""
    return edges_from_json(_lines(spark, path))


def save_aliases(aliases: DataFrame, path: str) -> None:
    aliases.select(F.to_json(F.create_map("alias", "canonical"))).write.text(path)


def save_edges(edges: DataFrame, path: str) -> None:
    """Targets in the order of `pos`, then by name."""
    targets = F.array_sort(F.collect_list(F.struct("pos", "dst")))["dst"]
    edges.groupBy("src").agg(targets.alias("targets")).select(F.to_json(F.create_map("src", "targets"))).write.text(path)


class MergeRefused(ValueError):
    """Nothing was published; `violations` (kind, name) says why."""

    def __init__(self, violations: DataFrame):
        super().__init__(f"{violations.count()} violations, among them {[tuple(r) for r in violations.limit(5).collect()]}")
        self.violations = violations


class KnowledgeBase:
    """Both maps below `path`. They are staged, checked and then published by one pointer
    row, so that a reader never meets the aliases of one version with the edges of another."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def publish(self, aliases: DataFrame, edges: DataFrame, version: int = 1) -> None:
        """Write (alias, canonical) and (src, dst, pos). Refused unless the files, read back,
        hold every alias and every edge once."""
        staged = f"{self.path}/maps/{uuid.uuid4().hex}"
        save_aliases(aliases, f"{staged}/aliases")
        save_edges(edges, f"{staged}/edges")
        twice = load_aliases(self.spark, f"{staged}/aliases").groupBy("alias").count().where("count > 1")
        again = load_edges(self.spark, f"{staged}/edges").groupBy("src", "dst").count().where("count > 1")
        self._refuse(
            twice.select(F.lit("repeated alias").alias("kind"), F.col("alias").alias("name")).union(
                again.select(F.lit("repeated edge"), F.concat_ws(" -> ", "src", "dst"))
            )
        )
        pointer = self.spark.createDataFrame([(version, staged)], "version long, folder string").coalesce(1)
        pointer.write.mode("error" if version == 1 else "append").parquet(f"{self.path}/pointer")

    def merge(self, canonicals: DataFrame, aliases: DataFrame, edges: DataFrame, strict_aliases: bool = False) -> None:
        """Add canonicals (skill), aliases (alias, canonical) and edges (src, dst, pos) as the next
        version, or raise `MergeRefused`. Known rows stay as they are; new targets follow the
        given ones; an alias that is canonical already becomes an edge to its target."""
        old_aliases, old_edges, version = self.aliases(), self.edges(), self.version()
        self._refuse(knowledge.violations(old_aliases, canonicals, aliases, edges, strict_aliases))
        equal = knowledge.equivalence_edges(old_aliases, aliases).withColumn("pos", F.lit(2**62))
        self.publish(
            knowledge.merge_aliases(old_aliases, canonicals, aliases),
            knowledge.append_edges(old_edges, edges.select("src", "dst", "pos").unionByName(equal)),
            version + 1,
        )

    def _refuse(self, violations: DataFrame) -> None:
        found = materialise(violations)
        if not found.isEmpty():
            raise MergeRefused(found)

    def _pointer(self, version: int | None):
        rows = self.spark.read.parquet(f"{self.path}/pointer")
        rows = rows if version is None else rows.where(F.col("version") <= version)
        return rows.agg(F.max("version"), F.max_by("folder", "version")).first()

    def version(self) -> int:
        return self._pointer(None)[0]

    def aliases(self, version: int | None = None) -> DataFrame:
        return load_aliases(self.spark, f"{self._pointer(version)[1]}/aliases")

    def edges(self, version: int | None = None) -> DataFrame:
        return load_edges(self.spark, f"{self._pointer(version)[1]}/edges")
