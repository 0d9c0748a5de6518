"""The end-to-end plan: normalised tables in, one scored row per application out.

Vocabulary work (canonical names, fuzzy neighbours, keys) happens once per
distinct string. What a candidate meets, and for how long, is worked out once
per candidate and class of equivalent names. Only then are applications expanded to required names,
once, feeding both the skill score and the depth score.

The expansion has tens of times the rows of the input. Beyond `SLICE_ROWS` of them the plan runs
slice by slice of candidates (`sliced`): results are written per slice, and the shuffle files
and scratch tables of a slice are gone before the next one starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentloom.operators import matching, scoring
from talentloom.operators.blocks import pair_cosines
from talentloom.operators.intervals import merged_months, union_months
from talentloom.session import discard, hot_keys, materialise, salted_join

# Rows of applications times required names that one slice may expand to: about what scale 0.1 has in all.
SLICE_ROWS = 12_000_000
# Tables of candidates, cut into slices together.
_BY_CANDIDATE = ("candidates", "cv_skills", "credentials", "employment", "stacks")


def _slices(rows: DataFrame) -> int:
    return -(-(rows.first()[0] or 0) // SLICE_ROWS) or 1


@dataclass
class Screening:
    """Inputs; derived tables are lazy, but for the vocabulary, which is written out once.

    applications  cv_id, jd_id
    candidates    cv_id, degree_rank, city, raw_address, willing_to_relocate, lat, lng
    cv_skills     cv_id, pos, skill
    credentials   cv_id, text
    employment    cv_id, job_id, start_m, end_m
    stacks        cv_id, job_id, skill
    jobs          jd_id, min_years, degree_rank, city, work_mode, lat, lng
    requirements  jd_id, tier, req_pos, alt_pos, name, weight
    aliases       alias, canonical
    implies       src, dst (closed)
    cv_vectors    cv_id, embedding
    jd_vectors    jd_id, embedding
    routes        lat1, lng1, lat2, lng2, duration_min
    """

    applications: DataFrame
    candidates: DataFrame
    cv_skills: DataFrame
    credentials: DataFrame
    employment: DataFrame
    stacks: DataFrame
    jobs: DataFrame
    requirements: DataFrame
    aliases: DataFrame
    implies: DataFrame
    cv_vectors: DataFrame
    jd_vectors: DataFrame
    routes: DataFrame

    # --- slices of candidates -----------------------------------------------------------

    @cached_property
    def slices(self) -> int:
        """How many slices of candidates keep the expansion of applications to names within `SLICE_ROWS`."""
        names = self.requirements.groupBy("jd_id").agg(F.count("*").alias("names"))
        asked = self.pairs.groupBy("jd_id").agg(F.count("*").alias("n")).join(names, "jd_id")
        return _slices(asked.agg(F.sum(F.col("n") * F.col("names"))))

    @cached_property
    def met_slices(self) -> int:
        """The same for the names that candidates' tokens meet."""
        return _slices(self.token_counts.join(self.index.select("token"), "token").agg(F.sum("n")))

    @cached_property
    def scratch(self) -> list[DataFrame]:
        """Tables written on the way to the results of this plan."""
        return []

    def give_up(self) -> None:
        """Delete the scratch tables, once nothing reads results that were not written in turn."""
        while self.scratch:
            discard(self.scratch.pop())

    def sliced(self, rows: Callable[[Screening], DataFrame], uses: tuple[str, ...], slices: int | None = None) -> DataFrame:
        """`rows` of the plan. Where the expansion is large, `rows` is run for one slice of the
        candidates after the other, and what it gives is written; so it must not combine
        candidates, or give parts that the caller combines. `uses` names the tables of the
        vocabulary it needs, worked out once over all candidates."""
        n = self.slices if slices is None else slices
        if n == 1:
            return rows(self)
        whole = replace(self, **{name: materialise(getattr(self, name)) for name in _BY_CANDIDATE})
        whole.scratch.extend(getattr(whole, name) for name in _BY_CANDIDATE)
        if slices is None:
            whole.__dict__["pairs"] = self.pairs
        shared = {name: self.__dict__[name] if name in self.__dict__ else getattr(whole, name) for name in uses}
        self.__dict__.update(shared)
        for k in range(n):
            part = whole._slice(k, n, shared)
            self.scratch.append(materialise(rows(part)))
            part.give_up()
        whole.give_up()
        return reduce(DataFrame.union, self.scratch[-n:])

    def _slice(self, k: int, n: int, shared: dict[str, DataFrame]) -> Screening:
        def cut(table: DataFrame) -> DataFrame:
            # Null is skipped in the hash, so a row without cv_id falls into a slice as well.
            return table.where(F.pmod(F.xxhash64("cv_id", F.lit("slice")), F.lit(n)) == k)

        applications = cut(self.__dict__.get("pairs", self.applications))
        part = replace(self, applications=applications, **{name: cut(getattr(self, name)) for name in _BY_CANDIDATE})
        part.__dict__.update(shared, pairs=applications, slices=1, met_slices=1)
        return part

    @cached_property
    def groups(self) -> DataFrame:
        return matching.requirement_groups(self.requirements)

    @cached_property
    def tokens(self) -> DataFrame:
        return matching.candidate_tokens(self.cv_skills, self.stacks, self.credentials)

    @cached_property
    def pairs(self) -> DataFrame:
        """The applications, written once, as scoring reads them several times."""
        return materialise(self.applications.select("cv_id", "jd_id"))

    @cached_property
    def cosines(self) -> DataFrame:
        return pair_cosines(self.pairs, self.cv_vectors, self.jd_vectors)

    @cached_property
    def token_counts(self) -> DataFrame:
        """(token, n): the vocabulary, with the number of candidates of every token."""
        return materialise(self.tokens.groupBy("token").agg(F.count("*").alias("n")))

    @cached_property
    def hot(self) -> DataFrame:
        return hot_keys(self.token_counts, "token")

    @cached_property
    def facts(self) -> DataFrame:
        return materialise(matching.token_facts(self.token_counts, self.aliases))

    @cached_property
    def given(self) -> DataFrame:
        return materialise(matching.token_keys(self.facts, self.implies))

    @cached_property
    def asked(self) -> DataFrame:
        names = self.requirements.select("name")
        return materialise(matching.name_keys(names, self.facts.select("token"), self.aliases))

    @cached_property
    def met(self) -> DataFrame:
        return self.sliced(lambda s: matching.met_names(s.tokens, s.index, s.hot), ("index", "hot"), self.met_slices)

    @cached_property
    def job_tokens(self) -> DataFrame:
        return self.stacks.select("cv_id", "job_id", F.lower("skill").alias("token"))

    @cached_property
    def worked(self) -> DataFrame:
        return matching.worked_names(self.job_tokens, self.employment, self.index, self.hot)

    @cached_property
    def index(self) -> DataFrame:
        return materialise(matching.name_index(self.given, self.asked))

    @cached_property
    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(name, class), and the index (token, class)."""
        class_of, class_asks = matching.ask_classes(self.asked, self.given)
        return materialise(class_of), materialise(matching.class_index(self.given, class_asks))

    @cached_property
    def months(self) -> DataFrame:
        return self.sliced(lambda s: matching.group_months(s.pairs, s.requirements, s.worked), ("index", "hot"))

    @cached_property
    def total_months(self) -> DataFrame:
        return merged_months(self.employment, ["cv_id"], out="total_months")

    @cached_property
    def evidence(self) -> DataFrame:
        return self.sliced(lambda s: matching.evidence(s.pairs, s.requirements, s.groups, s.met), ("index", "hot"))

    @cached_property
    def sums(self) -> DataFrame:
        """(cv_id, jd_id, got, months): matched weight, and weighted months as far as asked for.

        Applications are expanded to name classes and meet the classes of the candidate;
        groups of one class and of several go separate ways to the sums of the pair.
        """
        return self.sliced(lambda s: s._sums(), ("classes", "hot"))

    def _sums(self) -> DataFrame:
        class_of, index = self.classes
        listed = matching.listed_tokens(self.cv_skills, self.credentials)
        used = matching.stack_spans(self.job_tokens, self.employment)
        met = materialise(matching.met_classes(listed, used, index, self.hot))
        self.scratch.append(met)
        deep = (F.col("tier") == "required") & (F.col("min_years") > 0)
        weights = self.groups.select("jd_id", "req_pos", "weight")
        asked = (
            self.requirements.join(class_of, "name")
            .select("jd_id", "tier", "req_pos", "class")
            .distinct()
            .join(weights, ["jd_id", "req_pos"])
            .join(self.jobs.select("jd_id", "min_years"), "jd_id")
            .withColumn("classes", F.count("*").over(Window.partitionBy("jd_id", "req_pos")))
            .select("jd_id", "req_pos", "class", "classes", "weight", F.when(deep, F.col("min_years")).alias("years"))
        )
        counts = F.col("years").isNotNull() & (F.col("months") > 0)
        counted = F.when(counts, F.col("weight") * scoring.counted_months("months", "years")).otherwise(0)

        def met_by(some: DataFrame) -> DataFrame:
            return matching.asked_names(self.pairs, some).join(met, ["cv_id", "class"])

        # A group with one class needs no union of months, so only sums of it move on.
        single = met_by(asked.where("classes = 1")).select("cv_id", "jd_id", "weight", counted.alias("counted"))
        several = (
            met_by(asked.where("classes > 1"))
            .select(
                "cv_id", "jd_id", "req_pos", "weight", "years",
                F.when(F.col("years").isNotNull(), F.col("months")).alias("months"),
                F.when(F.col("years").isNotNull(), F.col("spans")).alias("spans"),
            )
            .groupBy("cv_id", "jd_id", "req_pos", "weight", "years")
            .agg(union_months("months", "spans").alias("months"))
            .select("cv_id", "jd_id", "weight", counted.alias("counted"))
        )
        return single.union(several).groupBy("cv_id", "jd_id").agg(F.sum("weight").alias("got"), F.sum("counted").alias("months"))

    @cached_property
    def dimensions(self) -> DataFrame:
        """(cv_id, jd_id) with the five dimensions in [0, 1]."""
        return self.sliced(lambda s: s._dimensions(), ("classes", "hot"))

    def _dimensions(self) -> DataFrame:
        required = F.col("tier") == "required"
        totals = self.groups.groupBy("jd_id").agg(
            F.sum("weight").alias("total_weight"),
            F.sum(F.when(required, F.col("weight")).otherwise(0)).alias("required_weight"),
        )
        jd = (
            self.jobs.join(totals, "jd_id", "left")
            .select(
                "jd_id", "min_years", "total_weight", "required_weight", "work_mode",
                F.col("degree_rank").alias("jd_rank"), F.col("city").alias("jd_city"),
                F.col("lat").alias("lat2"), F.col("lng").alias("lng2"),
            )
        )
        cv = (
            self.candidates.join(self.total_months, "cv_id", "left")
            .select(
                "cv_id", "total_months", "raw_address", "willing_to_relocate",
                F.col("degree_rank").alias("cv_rank"), F.col("city").alias("cv_city"),
                F.col("lat").alias("lat1"), F.col("lng").alias("lng1"),
            )
        )
        placed = salted_join(self.pairs, jd, ["jd_id"], ["cv_id"]).join(cv, "cv_id")
        slim = scoring.with_minutes(placed, self.routes).select(
            "cv_id",
            "jd_id",
            "min_years",
            "total_weight",
            "required_weight",
            scoring.years_share("total_months", "min_years").alias("general"),
            scoring.education_score("cv_rank", "jd_rank").alias("education"),
            scoring.location_score(
                F.col("work_mode"), F.col("willing_to_relocate"), F.col("raw_address"),
                F.col("cv_city"), F.col("jd_city"), scoring.has_coordinates(), F.col("duration_min"),
            ).alias("location"),
        )
        wide = slim.join(self.sums, ["cv_id", "jd_id"], "left").join(self.cosines, ["cv_id", "jd_id"], "left")
        depth = F.when(
            F.col("required_weight") > 0,
            F.try_divide(F.coalesce("months", F.lit(0)), F.col("min_years") * 12 * F.col("required_weight")),
        )
        return wide.select(
            "cv_id",
            "jd_id",
            scoring.semantic_score(F.col("cosine")).alias("semantic"),
            F.when(F.col("total_weight") > 0, F.try_divide(F.coalesce("got", F.lit(0)), F.col("total_weight")))
            .otherwise(1.0)
            .alias("skills"),
            scoring.experience_score("min_years", depth, F.col("general")).alias("experience"),
            "education",
            "location",
        )

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.final_scores(self.dimensions)
