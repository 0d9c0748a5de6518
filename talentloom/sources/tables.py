"""Domain views over the star-schema tables.

candidates = customer, their jobs = orders, stacks = lineitem x part, hiring
jobs = supplier, requirements = part, applications = orders x lineitem.
Every view is a lazy DataFrame that prunes columns at the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.functions import cleaning
from talentloom.functions.months import month_text, span
from talentloom.operators import knowledge, scoring
from talentloom.plans.screening import Screening
from talentloom.session import broadcast_by_rows

AS_OF = "2001-09"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        broadcast_by_rows(spark)

    def read(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*columns) if columns else df

    def _count(self, name: str) -> Column:
        return self.read(name).select(F.count("*")).scalar()

    # --- candidates ---------------------------------------------------------------

    @cached_property
    def raw_candidates(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        return self.read("customer").select(
            key.alias("cv_id"),
            (key % 50 != 7).alias("is_resume"),
            F.when(key % 40 == 0, "").otherwise(F.col("c_name")).alias("name"),
            F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("Works in "), "c_mktsegment")).alias("summary"),
            _pick(key % 8, "", "High School", "Associate of Science", "BSc Physics", "M.Eng", "Doctorate",
                  "Bootcamp", "master").alias("degree_text"),
            _pick(nation % 8, "", "High School", "Associate of Science", "BSc Physics", "M.Eng", "Doctorate",
                  "Bootcamp", "master").alias("second_degree_text"),
            _pick(nation % 4, "Hanoi", "TP. HCM", "Da Nang City", "Hue").alias("city_text"),
            F.when(key % 3 != 0, F.concat(F.lit("Street "), nation.cast("string"))).alias("raw_address"),
            F.when(key % 11 == 0, True).when(key % 11 == 1, False).alias("willing_to_relocate"),
            _pick(
                key % 3,
                F.concat(F.lit("Japanese - JLPT N"), (key % 5 + 1).cast("string")),
                F.concat(F.lit("English: TOEIC "), (key % 500 + 400).cast("string")),
                F.concat(F.lit("French (B"), (key % 2 + 1).cast("string"), F.lit(")")),
            ).alias("language"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        c = self.raw_candidates
        ranks = [cleaning.degree_rank(cleaning.degree(d)) for d in ("degree_text", "second_degree_text")]
        city = cleaning.candidate_city("city_text")
        placed = c.select(
            "cv_id", "is_resume", "name", "willing_to_relocate", "raw_address",
            F.greatest(*ranks).alias("degree_rank"),
            city.alias("city"),
            F.when(
                F.col("raw_address").isNotNull(), F.concat_ws(", ", F.col("raw_address"), city)
            ).alias("address"),
        )
        return scoring.geocode(placed, "address", self.gazetteer).drop("address")

    @cached_property
    def cv_skills(self) -> DataFrame:
        """Ten listed skills per candidate; one of them is not a known skill."""
        key = F.col("c_custkey")
        wanted = self.read("customer", "c_custkey").select(
            key.alias("cv_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pos")
        )
        wanted = wanted.withColumn("p_partkey", (F.col("cv_id") * 7 + F.col("pos") * 13) % self._count("part"))
        skill = (
            F.when(F.col("pos") == 5, F.col("p_brand"))
            .when(F.col("pos") % 2 == 0, F.initcap("p_name"))
            .otherwise(F.col("p_name"))
        )
        return wanted.join(self.read("part", "p_partkey", "p_name", "p_brand"), "p_partkey").select(
            "cv_id", "pos", skill.alias("skill")
        )

    @cached_property
    def credentials(self) -> DataFrame:
        return self.raw_candidates.select("cv_id", F.col("language").alias("text"))

    @cached_property
    def raw_employment(self) -> DataFrame:
        """One job per order, dates as the untidy text a document would carry."""
        key = F.col("o_orderkey")
        first = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
        start = month_text(first)
        end = month_text(first + 1 + (key % 36).cast("int"))
        return self.read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").select(
            F.col("o_custkey").alias("cv_id"),
            key.alias("job_id"),
            F.when(key % 97 == 0, "")
            .when(F.col("o_orderpriority") == "1-URGENT", F.replace(start, F.lit("-"), F.lit("/")))
            .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(" "), start))
            .otherwise(start)
            .alias("start"),
            F.when(F.col("o_orderstatus") == "P", "Present").when(key % 89 == 0, "").otherwise(end).alias("end"),
        )

    @cached_property
    def employment(self) -> DataFrame:
        start, end = span("start", "end", AS_OF)
        return self.raw_employment.select("cv_id", "job_id", start.alias("start_m"), end.alias("end_m"))

    @cached_property
    def stacks(self) -> DataFrame:
        orders = self.read("orders", "o_orderkey", "o_custkey")
        lines = self.read("lineitem", "l_orderkey", "l_partkey")
        parts = self.read("part", "p_partkey", "p_name")
        return (
            lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", F.col("p_name").alias("skill"))
            .distinct()
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("job_id"), "skill")
        )

    # --- hiring jobs --------------------------------------------------------------

    @cached_property
    def raw_jobs(self) -> DataFrame:
        key, nation = F.col("s_suppkey"), F.col("s_nationkey")
        return self.read("supplier").select(
            key.alias("jd_id"),
            F.col("s_name").alias("title"),
            F.when(key % 5 == 0, "")
            .otherwise(F.concat(F.lit("Serve nation "), nation.cast("string")))
            .alias("responsibilities"),
            _pick(key % 7, "", "1", "1.5", "3", "abc", "4.2", "6").alias("min_years_text"),
            _pick(key % 8, None, "none", "bachelor", "master", "phd", "associate", "high_school", "n/a").alias(
                "education_text"
            ),
            _pick(key % 4, "Onsite ", "HYBRID", "remote", "oversea").alias("work_mode_text"),
            _pick(nation % 4, "ha noi", "Saigon", "danang", "Unknown").alias("city_text"),
            F.when(key % 4 == 1, "")
            .otherwise(F.concat(F.lit("Street "), nation.cast("string")))
            .alias("raw_address"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        city = cleaning.job_city("city_text")
        placed = self.raw_jobs.select(
            "jd_id", "title", "responsibilities", "raw_address",
            cleaning.min_years("min_years_text").alias("min_years"),
            cleaning.job_degree("education_text").alias("degree"),
            cleaning.degree_rank(cleaning.job_degree("education_text")).alias("degree_rank"),
            cleaning.work_mode("work_mode_text").alias("work_mode"),
            city.alias("city"),
            F.when(F.col("raw_address") != "", F.concat_ws(", ", F.col("raw_address"), city))
            .otherwise(city)
            .alias("address"),
        )
        return scoring.geocode(placed, "address", self.gazetteer).drop("address")

    @cached_property
    def raw_requirements(self) -> DataFrame:
        """Required groups of two names first, then single preferred and nice-to-have names."""
        key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
        n = self._count("supplier")
        written = (
            F.when(size % 10 <= 2, F.initcap(name))
            .when(size % 10 == 3, F.upper(F.replace(name, F.lit(" "), F.lit("-"))))
            .when(size % 10 == 4, F.concat(name, F.lit("s")))
            .when(size % 10 == 5, F.replace(name, F.lit(" "), F.lit("")))
            .when(size % 10 == 6, F.concat(F.lit("JLPT N"), (key % 5 + 1).cast("string")))
            .when(size % 10 == 7, F.concat(F.lit("TOEIC "), (size * 8 + 400).cast("string")))
            .when((size % 10 == 8) & (key % 2 == 0), F.lit("Problem-Solving"))
            .otherwise(name)
        )
        placed = self.read("part", "p_partkey", "p_name", "p_size").select(
            (key % n).alias("jd_id"), F.floor(key / n).cast("int").alias("pos"), size, written.alias("name")
        )
        required = F.col("pos") < 12
        tier = F.when(required, "required").when(F.col("pos") < 16, "preferred").otherwise("nice_to_have")
        return placed.select(
            "jd_id",
            tier.alias("tier"),
            F.when(required, F.floor(F.col("pos") / 2).cast("int")).otherwise(F.col("pos") + 100).alias("req_pos"),
            F.when(required, F.col("pos") % 2).otherwise(0).alias("alt_pos"),
            "name",
            F.when(required, F.col("p_size") % 3 + 1)
            .when(F.col("pos") < 16, 2)
            .otherwise(1)
            .alias("weight"),
        )

    @cached_property
    def requirements(self) -> DataFrame:
        """Requirements without those whose representative is no skill at all."""
        raw = self.raw_requirements
        generic = raw.filter((F.col("alt_pos") == 0) & cleaning.is_generic_skill("name"))
        return raw.join(generic.select("jd_id", "req_pos"), ["jd_id", "req_pos"], "left_anti")

    @cached_property
    def applications(self) -> DataFrame:
        orders = self.read("orders", "o_orderkey", "o_custkey")
        lines = self.read("lineitem", "l_orderkey", "l_suppkey")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("cv_id"), F.col("l_suppkey").alias("jd_id"))
            .distinct()
        )

    # --- knowledge base -----------------------------------------------------------

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.read("part", "p_name").distinct().select("p_name")

    @cached_property
    def tags(self) -> DataFrame:
        """Known skills are the names without 'ring'; tags in a collective are dropped."""
        name = F.col("p_name")
        dashed = F.replace(name, F.lit(" "), F.lit("-"))
        return self.vocabulary.select(
            dashed.alias("name"),
            name.startswith("new").alias("has_synonyms"),
            F.when(name.endswith(" ring"), F.array(F.lit("rings"))).alias("collectives"),
        )

    @cached_property
    def synonyms(self) -> DataFrame:
        name = F.col("p_name")
        dashed = F.replace(name, F.lit(" "), F.lit("-"))
        known = self.vocabulary.filter(~name.endswith(" ring"))
        old = known.filter(name.startswith("old ")).select(
            F.lit(1).alias("seq"), dashed.alias("from_tag"), F.replace(dashed, F.lit("old-"), F.lit("new-")).alias("to_tag")
        )
        joined = known.filter(~name.startswith("old ")).select(
            F.lit(2), F.replace(name, F.lit(" "), F.lit("")), dashed
        )
        return old.union(joined)

    @cached_property
    def aliases(self) -> DataFrame:
        return knowledge.build_aliases(knowledge.without_collectives(self.tags), self.synonyms)

    @cached_property
    def edges(self) -> DataFrame:
        """Chains new -> red -> hot -> cold and large -> small within each noun."""
        name = F.col("p_name")
        parent = (
            F.when(name.startswith("new "), "red").when(name.startswith("red "), "hot")
            .when(name.startswith("hot "), "cold").when(name.startswith("large "), "small")
        )
        noun = F.element_at(F.split(name, " "), -1)
        return (
            self.vocabulary.filter(~name.endswith(" ring"))
            .select(F.replace(name, F.lit(" "), F.lit("-")).alias("src"), F.concat_ws("-", parent, noun).alias("dst"), parent.alias("p"))
            .filter("p is not null")
            .select("src", "dst")
        )

    @cached_property
    def implies(self) -> DataFrame:
        return knowledge.transitive_closure(self.edges)

    # --- places, vectors ------------------------------------------------------------

    @cached_property
    def gazetteer(self) -> DataFrame:
        """Streets that can be located, and the three cities."""
        n = F.col("n_nationkey")
        city = F.coalesce(_pick(n % 4, "Ha Noi", "Ho Chi Minh", "Da Nang"), F.lit("Ha Noi"))
        nations = self.read("nation", "n_nationkey")
        streets = nations.filter(n % 5 != 0).select(
            F.concat(F.lit("Street "), n.cast("string"), F.lit(", "), city).alias("address"),
            (n * 0.5 + 10).cast("double").alias("lat"),
            (n * 0.25 + 100).cast("double").alias("lng"),
        )
        cities = nations.filter(n < 3).select(
            city, (n * 0.5 + 10).cast("double"), (n * 0.25 + 100).cast("double")
        )
        return streets.union(cities)

    @cached_property
    def routes(self) -> DataFrame:
        """Driving minutes between located places; some routes are missing."""
        a, b = F.col("a"), F.col("b")
        ends = self.read("nation", "n_nationkey").select(
            F.col("n_nationkey").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("b")
        )
        return ends.filter((a + b) % 9 != 4).select(
            (a * 0.5 + 10).cast("double").alias("lat1"),
            (a * 0.25 + 100).cast("double").alias("lng1"),
            (b * 0.5 + 10).cast("double").alias("lat2"),
            (b * 0.25 + 100).cast("double").alias("lng2"),
            (F.abs(a - b) * 7.0 + 3.0).alias("duration_min"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings", "vec_id", "embedding")

    @cached_property
    def units(self) -> DataFrame:
        return scoring.unit_vectors(self.vectors, "vec_id")

    @cached_property
    def cv_vectors(self) -> DataFrame:
        return self.vectors.withColumnRenamed("vec_id", "cv_id")

    @cached_property
    def jd_vectors(self) -> DataFrame:
        return self.vectors.withColumnRenamed("vec_id", "jd_id")

    @cached_property
    def vector_labels(self) -> DataFrame:
        return self.read("embeddings", "vec_id", "label")

    @cached_property
    def screening(self) -> Screening:
        return Screening(
            applications=self.applications,
            candidates=self.candidates,
            cv_skills=self.cv_skills,
            credentials=self.credentials,
            employment=self.employment,
            stacks=self.stacks,
            jobs=self.jobs,
            requirements=self.requirements,
            aliases=self.aliases,
            implies=self.implies,
            cv_vectors=self.cv_vectors,
            jd_vectors=self.jd_vectors,
            routes=self.routes,
        )

    # --- semantic pairs ---------------------------------------------------------------

    @cached_property
    def labelled_pairs(self) -> DataFrame:
        """Applications whose two vectors exist, with cosine (to six decimals, so that thresholds
        and ties mean the same everywhere) and whether labels agree."""
        scored = self.screening.cosines.withColumn("cosine", F.round("cosine", 6)).drop("problem")
        labels = self.vector_labels
        cv = labels.select(F.col("vec_id").alias("cv_id"), F.col("label").alias("cv_label"))
        jd = labels.select(F.col("vec_id").alias("jd_id"), F.col("label").alias("jd_label"))
        return (
            scored.filter(F.col("cosine").isNotNull())
            .join(cv, "cv_id")
            .join(jd, "jd_id")
            .withColumn("same", F.col("cv_label") == F.col("jd_label"))
        )

    # --- batches ------------------------------------------------------------------------

    @cached_property
    def results(self) -> DataFrame:
        """One stored result per event; `ord` is the position in the batch."""
        key = F.col("event_id")
        k = F.get_json_object("props", "$.k").cast("int")
        failed = F.col("event_type") == "error"
        return self.read("events", "event_id", "user_id", "event_type", "value", "props").select(
            F.col("user_id").alias("batch_id"),
            key.alias("ord"),
            F.concat(F.lit("https://cv.example.org/"), key.cast("string"), F.lit(".pdf")).alias("cv_url"),
            F.when(failed, "No text could be extracted from file").alias("error"),
            F.when(~failed, F.least(F.col("value"), F.lit(100.0))).alias("final_score"),
            (~failed & (key % 17 != 0)).alias("has_record"),
            F.when(~failed & (k % 10 != 0), 64).alias("vector_size"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        n = self._count("supplier")
        user = F.col("user_id")
        return (
            self.read("events", "user_id", "ts")
            .groupBy("user_id")
            .agg(F.min("ts").alias("created_at"))
            .select(
                user.alias("batch_id"),
                F.concat(F.lit("batch "), user.cast("string")).alias("name"),
                F.when(user % 7 != 0, user % n).alias("jd_id"),
                F.lit(None).cast("map<string,double>").alias("weights"),
                F.lit(False).alias("include_narrative"),
                "created_at",
            )
        )


def _pick(index: Column, *values: Column | str | None) -> Column:
    """values[index], null past the end."""
    chosen = None
    for i, value in enumerate(values):
        value = value if isinstance(value, Column) else F.lit(value)
        chosen = (F if chosen is None else chosen).when(index == i, value)
    return chosen


def record_json(t: Tables) -> DataFrame:
    """(cv_id, body): each customer as JSON text; some with a trailing comma, some cut short."""
    key = F.col("cv_id")
    text = key.cast("string")
    pieces = [
        F.lit('{"is_resume": '), F.col("is_resume").cast("string"),
        F.lit(', "name": "'), F.col("name"), F.lit('", "summary": "'), F.col("summary"),
        F.lit('", "skills": ["Go", "  ", "'), F.lower(F.col("c_mktsegment")),
        F.lit('"], "work_experience": [{"company": "'), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("C"), text)),
        F.lit('", "role": "Dev", "start": "'),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("2000-0"), (key % 9 + 1).cast("string"))),
        F.lit('", "end": "'), F.when(key % 2 == 0, "Present").otherwise("2001-05"),
        F.lit('", "months": 7, "tech_stack": ["go"], "description": "'), F.when(key % 5 == 0, "").otherwise("Built things"),
        F.lit('"}, {"company": "Old Co", "role": "Intern", "start": "1998-01", "end": "1999-01"}, {"role": "Ghost"}], '),
        F.lit('"education": [{"institution": "U", "degree": "'), F.col("degree_text"),
        F.lit('", "degree_raw": "'), F.col("degree_text"), F.lit('", "major": "M'), (key % 6).cast("string"),
        F.lit('"}, {"degree": "phd"}], "projects": [{"name": "", "description": ""}, {"name": "P'), text,
        F.lit('", "tech_stack": null, "description": "'), F.when(key % 7 == 0, "").otherwise("Fun"),
        F.lit('"}], "certifications": ["AWS", {"name": "CKA"}, {"title": "PMP"}], "languages": ["'), F.col("language"),
        F.lit('"], "candidate_location": {"city": "'), F.col("city_text"),
        F.lit('", "raw_address": "'), F.coalesce("raw_address", F.lit(" ")), F.lit('"'),
        F.when(key % 10 == 3, ",}").otherwise("}"),
        F.when(key % 25 == 4, "").otherwise("}"),
    ]
    segments = t.read("customer", "c_custkey", "c_mktsegment").select(key_of("c_custkey"), "c_mktsegment")
    # Few bytes, but long to parse: dealt out by rows, as files are cut by bytes.
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return t.raw_candidates.join(segments, "cv_id").repartition(parts).select("cv_id", F.concat(*pieces).alias("body"))


def key_of(column: str) -> Column:
    return F.col(column).alias("cv_id")
