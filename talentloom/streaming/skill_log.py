"""The log of unknown skills as keyed state of a stream.

A token is unknown if no spelling of it is an alias and it is no proficiency level; that
needs only the row. How many different candidates used it and when it was last seen is
state: a map of candidates per (token, slice of candidates), so a token that very many
candidates use has many small maps instead of one large. Near spellings of known skills
depend on the vocabulary alone and are told apart once per distinct token, when the log is
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from talentloom.functions.skills import proficiency, spelling_variants
from talentloom.functions.strings import strip
from talentloom.operators.fuzzy import fuzzy_pairs
from talentloom.streaming.arrivals import run_to_parquet

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPELLINGS = 6


def unlisted(sightings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of sightings (token, cv_name, seen_on), those of tokens no alias spells and that are no
    proficiency level. Joins with the alias table only, so it works on a stream."""
    rows = sightings.withColumn("token", F.lower(strip("token"))).where("token <> ''").where(proficiency("token").isNull())
    listed = aliases.select(F.col("alias").alias("_alias")).distinct()
    for i in range(SPELLINGS):
        spelled = rows.withColumn("_spelled", F.get(spelling_variants("token"), F.lit(i)))
        rows = spelled.join(listed, F.col("_spelled") == F.col("_alias"), "left_anti").drop("_spelled")
    return rows


def counter() -> StatefulProcessor:
    """Counts the candidates of a (token, slice). Made inside, so that workers receive the
    class itself and need no install."""

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getMapState("seen", "cv_name string", "seen_on string")
            self.total = handle.getValueState("total", "cv_count bigint, last_seen string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            count, last = self.total.get() if self.total.exists() else (0, "")
            for frame in rows:
                for name, day in frame.groupby("cv_name")["seen_on"].max().items():
                    last = max(last, day)
                    if not self.seen.containsKey((name,)):
                        self.seen.updateValue((name,), (day,))
                        count += 1
            self.total.update((count, last))
            yield pd.DataFrame({"token": [key[0]], "slice": [key[1]], "cv_count": [count], "last_seen": [last]})

        def close(self) -> None:
            pass

    return Counter()


def run_log(sightings: DataFrame, aliases: DataFrame, slices: int = 16, path: str | None = None) -> str:
    """Feed the log with what is available of a stream (token, cv_name, seen_on)."""
    spark = sightings.sparkSession
    part = F.pmod(F.xxhash64("cv_name"), F.lit(slices)).cast("int")
    keyed = unlisted(sightings, aliases).select("token", part.alias("slice"), "cv_name", "seen_on").groupBy("token", "slice")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # map state needs it
    try:
        counted = keyed.transformWithStateInPandas(counter(), "token string, slice int, cv_count bigint, last_seen string", "Update", "None")
        return run_to_parquet(counted, lambda batch: batch, "update", path)
    finally:
        spark.conf.set(STORE, before)


def read_log(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(skill, cv_count, last_seen) of what the log has written (token, slice, cv_count,
    last_seen, epoch), without near spellings of known skills."""
    latest = rows.groupBy("token", "slice").agg(F.max_by(F.struct("cv_count", "last_seen"), "epoch").alias("now"))
    sums = latest.groupBy("token").agg(F.sum("now.cv_count").alias("cv_count"), F.max("now.last_seen").alias("last_seen"))
    vocabulary = aliases.select(F.col("alias").alias("name")).union(aliases.where("canonical IS NOT NULL").select("canonical")).distinct()
    near = fuzzy_pairs(sums.select(F.col("token").alias("name")), vocabulary).select(F.col("a").alias("token"))
    return sums.join(near, "token", "left_anti").select(F.col("token").alias("skill"), "cv_count", "last_seen")
