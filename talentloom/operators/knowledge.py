"""Building, extending, checking and closing the skill knowledge base.

kb_alias(alias, canonical): canonical is null where the alias is itself canonical.
kb_implies(src, dst): directed edges between canonical skills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.operators.ranking import numbered
from talentloom.session import materialise


def without_collectives(tags: DataFrame) -> DataFrame:
    return tags.filter(F.coalesce(F.size("collectives"), F.lit(0)) <= 0)


def build_aliases(tags: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Tags map to null, or to themselves when they have synonyms; synonym rows override.

    `synonyms` carries `seq`: of several rows for one tag the last one counts.
    """
    own = tags.groupBy(F.col("name").alias("alias")).agg(
        F.when(F.bool_or("has_synonyms"), F.first("name")).alias("own")
    )
    override = synonyms.groupBy(F.col("from_tag").alias("alias")).agg(
        F.max_by("to_tag", "seq").alias("target")
    )
    return own.join(override, "alias", "full_outer").select(
        "alias", F.coalesce("target", "own").alias("canonical")
    )


def canonical_skills(aliases: DataFrame) -> DataFrame:
    """Aliases that are canonical: present, and mapped to nothing or to themselves."""
    return aliases.filter(F.col("canonical").isNull() | (F.col("canonical") == F.col("alias"))).select(
        F.col("alias").alias("skill")
    )


def merge_aliases(
    aliases: DataFrame, new_canonicals: DataFrame, new_aliases: DataFrame
) -> DataFrame:
    """Add canonicals, then aliases; rows already present are kept as they are."""
    extra = new_canonicals.select(
        F.col("skill").alias("alias"), F.lit(None).cast("string").alias("canonical")
    ).distinct()
    extra = extra.join(aliases, "alias", "left_anti")
    merged = aliases.unionByName(extra)
    more = new_aliases.groupBy("alias").agg(F.min("canonical").alias("canonical")).join(merged, "alias", "left_anti")
    return merged.unionByName(more.select("alias", "canonical"))


def merge_edges(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(new_edges.select("src", "dst")).distinct()


def equivalence_edges(aliases: DataFrame, new_aliases: DataFrame) -> DataFrame:
    """A new alias that is already canonical becomes an edge to its target instead."""
    known = canonical_skills(aliases).withColumnRenamed("skill", "alias")
    return (
        new_aliases.filter(F.col("alias") != F.col("canonical"))
        .join(known, "alias", "left_semi")
        .select(F.col("alias").alias("src"), F.col("canonical").alias("dst"))
        .distinct()
    )


def violations(
    aliases: DataFrame,
    new_canonicals: DataFrame,
    new_aliases: DataFrame,
    new_edges: DataFrame,
    strict_aliases: bool = False,
) -> DataFrame:
    """Rows that must be empty before a merge may be written: (kind, name)."""
    known = canonical_skills(merge_aliases(aliases, new_canonicals, new_aliases.limit(0)))

    def missing(names: DataFrame, kind: str) -> DataFrame:
        return names.join(known, "skill", "left_anti").select(
            F.lit(kind).alias("kind"), F.col("skill").alias("name")
        )

    found = missing(new_canonicals.select("skill"), "canonical")
    found = found.union(missing(new_aliases.select(F.col("canonical").alias("skill")), "alias target"))
    found = found.union(missing(new_edges.select(F.col("src").alias("skill")), "edge source"))
    found = found.union(missing(new_edges.select(F.col("dst").alias("skill")), "edge target"))
    if strict_aliases:
        clash = (
            new_aliases.select("alias", F.col("canonical").alias("wanted"))
            .join(aliases, "alias")
            .filter(
                (F.col("alias") != F.col("wanted")) & ~F.col("canonical").eqNullSafe(F.col("wanted"))
            )
            .select(F.lit("alias clash").alias("kind"), F.col("alias").alias("name"))
        )
        found = found.union(clash)
    return found.distinct()


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) reachable over one or more edges, self edges left out."""
    return _grown([], _proper(edges))


def extend_closure(closed: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The closure after edges were added: only pairs that need a new edge are worked out.

    The first pairs to grow from are those with one new edge between known paths.
    """
    closed, new = _proper(closed), materialise(_proper(new_edges))
    before = _steps(closed, new).union(new)
    around = _proper(before.union(_steps(before, closed)))
    return _grown([closed], around.join(closed, ["src", "dst"], "left_anti"))


def _proper(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def _steps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (src, dst) with a path of `first` followed by one of `second`."""
    onward = second.select(F.col("src").alias("mid"), "dst")
    return first.withColumnRenamed("dst", "mid").join(onward, "mid").where("src <> dst").select("src", "dst")


def _grown(known: list[DataFrame], delta: DataFrame) -> DataFrame:
    """Adds what follows from the pairs of the last round alone.

    A shortest path that is new in a round starts with a pair of the round before and goes
    on with a known one, so lengths double: a chain of n edges takes about log2(n)
    rounds. Every pair is written once, in the round that finds it.
    """
    delta = materialise(delta)
    while not delta.isEmpty():
        known = [*known, delta]
        closed = reduce(DataFrame.union, known)
        delta = materialise(_steps(delta, closed).distinct().join(closed, ["src", "dst"], "left_anti"))
    return reduce(DataFrame.union, known) if known else delta


def append_edges(edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(src, dst, pos): new targets of a source come after those it has, in their own order."""
    fresh = new_edges.groupBy("src", "dst").agg(F.min("pos").alias("later")).join(edges, ["src", "dst"], "left_anti")
    behind = edges.groupBy("src").agg((F.max("pos") + 1).alias("behind"))
    placed = numbered(fresh, ["src"], [F.asc("later"), F.asc("dst")], "place").join(behind, "src", "left")
    pos = F.coalesce("behind", F.lit(0)) + F.col("place") - 1
    return edges.select("src", "dst", "pos").unionByName(placed.select("src", "dst", pos.cast("bigint").alias("pos")))


def closure_in_order(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Per source: edges as given (by `pos`), then the derived ones sorted."""
    given = edges.select("src", "dst", F.lit(0).alias("derived"), "pos")
    derived = closed.join(edges, ["src", "dst"], "left_anti").select(
        "src", "dst", F.lit(1).alias("derived"), F.lit(0).cast("bigint").alias("pos")
    )
    ordered = F.array_sort(F.collect_list(F.struct("derived", "pos", "dst")))
    return (
        given.union(derived)
        .groupBy("src")
        .agg(ordered.alias("targets"))
        .select("src", F.col("targets.dst").alias("targets"))
    )


def closure_stats(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Source count, edges before and after, and sources that gained an edge."""
    before = edges.groupBy("src").agg(F.count_distinct("dst").alias("before"))
    after = closed.groupBy("src").agg(F.count("*").alias("after"))
    return (
        before.join(after, "src", "left")
        .agg(
            F.count("*").alias("n_keys"),
            F.sum("before").alias("edges_before"),
            F.sum(F.coalesce("after", "before")).alias("edges_after"),
            F.sum((F.col("after") > F.col("before")).cast("bigint")).alias("changed_keys"),
        )
    )


def closure_gaps(edges: DataFrame) -> DataFrame:
    """(x, z) with x -> y -> z but no x -> z."""
    first = edges.select(F.col("src"), F.col("dst").alias("mid"))
    second = edges.select(F.col("src").alias("mid"), F.col("dst"))
    return (
        first.join(second, "mid")
        .filter("src <> dst")
        .select("src", "dst")
        .distinct()
        .join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    )


def non_canonical_edge_ends(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("skill"), F.lit("source").alias("side")).union(
        edges.select(F.col("dst").alias("skill"), F.lit("target").alias("side"))
    )
    return ends.distinct().join(canonical_skills(aliases), "skill", "left_anti").select("side", "skill")
