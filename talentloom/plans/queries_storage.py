"""Screening batches, stored results, exports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.functions.strings import fixed
from talentloom.operators import batches, ranking
from talentloom.plans import oracle as o
from talentloom.plans.queries_knowledge import sighted
from talentloom.plans.registry import query
from talentloom.session import materialise, new_folder
from talentloom.sources.sinks import score_table
from talentloom.sources.tables import AS_OF, Tables
from talentloom.sources.versions import VersionedTable
from talentloom.streaming import scoring_stream, skill_log


def stored(t: Tables, rows: DataFrame, keys: list[str]) -> VersionedTable:
    """Rows as the first version of a stored table."""
    table = VersionedTable(t.spark, new_folder(t.spark), rows.schema, keys)
    table.create(rows)
    return table


def stored_results(t: Tables) -> VersionedTable:
    return stored(t, t.results, ["batch_id", "ord"])


def stored_batches(t: Tables) -> VersionedTable:
    return stored(t, t.batches, ["batch_id"])


@query(
    "A3_J17_batch_listing",
    o.sql("""
      SELECT b.batch_id, b.name, coalesce(j.title, '') AS jd_title, count(r.ord) AS candidate_count,
        row_number() OVER (ORDER BY any_value(b.created_at) DESC, b.batch_id) AS newest
      FROM batches b LEFT JOIN jobs j ON j.jd_id = b.jd_id LEFT JOIN results r ON r.batch_id = b.batch_id
      GROUP BY b.batch_id, b.name, j.title"""),
)
def _(t: Tables) -> DataFrame:
    """Newest first; the position is part of the result."""
    listing = batches.batch_listing(t.batches, t.results, t.jobs)
    order = [F.desc("created_at"), F.asc("batch_id")]
    return ranking.numbered(listing, [], order, "newest").select(
        "batch_id", "name", F.coalesce("jd_title", F.lit("")).alias("jd_title"), "candidate_count", "newest"
    )


@query(
    "S3_batch_results_in_order",
    o.sql("""
      SELECT r.batch_id, b.name, r.cv_url, row_number() OVER (PARTITION BY r.batch_id ORDER BY r.ord) AS position
      FROM results r JOIN batches b ON b.batch_id = r.batch_id"""),
)
def _(t: Tables) -> DataFrame:
    joined = batches.batch_results(t.batches.select("batch_id", "name"), t.results.select("batch_id", "ord", "cv_url"))
    placed = ranking.numbered(joined, ["batch_id"], [F.asc("ord")], "position")
    return placed.select("batch_id", "name", "cv_url", "position")


@query(
    "S4_score_table",
    o.sql(f"""
      SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY final_score DESC, ord) AS row_index,
        ord || '.pdf' AS cv, {o.fixed('final_score', 1)} AS final_score
      FROM results WHERE error IS NULL"""),
)
def _(t: Tables) -> DataFrame:
    scored, _failed = batches.split_by_error(t.results)
    order = [F.desc("final_score"), F.asc("ord")]
    return score_table(scored, ["batch_id"], order, ())


@query(
    "S5_result_upsert",
    o.sql(f"""
      SELECT ord, batch_id, coalesce(error, '') AS error,
        CASE WHEN error IS NULL AND has_record AND vector_size > 0 THEN {o.fixed('final_score / 2', 3)}
          ELSE coalesce({o.fixed('final_score', 3)}, '') END AS final_score
      FROM results"""),
)
def _(t: Tables) -> DataFrame:
    """Re-scored rows (here: half the score) replace the stored ones in a second version."""
    table = stored_results(t)
    rescore, _reparse = batches.rescore_split(table.read())
    table.upsert(rescore.withColumn("final_score", F.col("final_score") / 2))
    return table.read().select(
        "ord", "batch_id", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(fixed("final_score", 3), F.lit("")).alias("final_score"),
    )


@query(
    "S7_failed_and_scored",
    o.sql("SELECT batch_id, count(*) FILTER (error IS NULL) AS scored, count(*) FILTER (error IS NOT NULL) AS failed FROM results GROUP BY 1"),
)
def _(t: Tables) -> DataFrame:
    scored, failed = batches.split_by_error(t.results)
    a = scored.groupBy("batch_id").agg(F.count("*").alias("scored"))
    b = failed.groupBy("batch_id").agg(F.count("*").alias("failed"))
    return a.join(b, "batch_id", "full_outer").na.fill(0, ["scored", "failed"])


@query(
    "J21_rescore_split",
    o.sql("""
      SELECT batch_id, ord, CASE WHEN has_record AND coalesce(vector_size, 0) > 0 THEN 'rescore' ELSE 'needs_reparse' END AS list
      FROM results WHERE error IS NULL"""),
)
def _(t: Tables) -> DataFrame:
    rescore, reparse = batches.rescore_split(stored_results(t).read())
    return rescore.select("batch_id", "ord", F.lit("rescore").alias("list")).union(
        reparse.select("batch_id", "ord", F.lit("needs_reparse"))
    )


@query(
    "S9_partial_update",
    o.sql("""
      SELECT b.batch_id, CASE WHEN u.e % 3 <> 0 THEN 'renamed ' || u.e ELSE b.name END AS name,
        CASE WHEN u.e % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS w_skills, coalesce(u.e % 5 = 0, false) AS include_narrative
      FROM batches b LEFT JOIN (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'signup' GROUP BY 1) u ON u.user_id = b.batch_id"""),
)
def _(t: Tables) -> DataFrame:
    """The last signup event of a batch carries the update; each field only at times."""
    e = F.col("e")
    last = t.read("events", "event_id", "user_id", "event_type").filter("event_type = 'signup'").groupBy(
        F.col("user_id").alias("batch_id")
    ).agg(F.max("event_id").alias("e"))
    updates = last.select(
        "batch_id",
        F.when(e % 3 != 0, F.concat(F.lit(" renamed "), e.cast("string"))).otherwise("  ").alias("name"),
        (e % 2 == 0).alias("has_weights"),
        F.create_map(F.lit("skills"), F.lit(1.0)).alias("weights"),
        (e % 5 == 0).alias("has_narrative"),
        F.lit(True).alias("include_narrative"),
    )
    table = stored_batches(t)
    named = table.read().join(updates.select("batch_id"), "batch_id", "left_semi")
    table.upsert(batches.update_configs(named, updates))
    return table.read().select(
        "batch_id", "name", F.coalesce(F.try_element_at("weights", F.lit("skills")), F.lit(-1.0)).alias("w_skills"), "include_narrative"
    )


@query(
    "J19_cascade_delete",
    o.sql("""
      SELECT batch_id, count(*) AS results_left FROM results WHERE batch_id NOT IN (SELECT batch_id FROM batches WHERE jd_id IS NULL)
      GROUP BY batch_id"""),
)
def _(t: Tables) -> DataFrame:
    """Batches without a job go, with their results."""
    held, results = stored_batches(t), stored_results(t)
    doomed = held.read().filter("jd_id is null").select("batch_id")
    results.delete(doomed, ["batch_id"])
    held.delete(doomed, ["batch_id"])
    kept = results.read().join(held.read().select("batch_id"), "batch_id", "left_semi")
    return kept.groupBy("batch_id").agg(F.count("*").alias("results_left"))


@query(
    "J16_embedding_reuse",
    """
      WITH cache AS (SELECT DISTINCT sha256('model-1::' || text) AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
      SELECT doc_id, sha256('model-1::' || text) IN (SELECT key FROM cache) AS cached FROM documents""",
)
def _(t: Tables) -> DataFrame:
    """Labelled documents count as embedded before; copies of their text need no new vector."""
    docs = t.read("documents", "doc_id", "text").select(
        "doc_id", F.sha2(F.concat_ws("::", F.lit("model-1"), "text"), 256).alias("key")
    )
    known = docs.join(t.read("labels", "doc_id"), "doc_id", "left_semi").select("key").distinct()
    return docs.join(known.withColumn("hit", F.lit(True)), "key", "left").select(
        "doc_id", F.coalesce("hit", F.lit(False)).alias("cached")
    )


def arriving_records(t: Tables) -> DataFrame:
    """(value): each candidate with jobs and vector as a line of JSON; some lines arrive
    again cut short."""
    skills = t.cv_skills.groupBy("cv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "skill")))["skill"].alias("skills"))
    stacks = t.stacks.groupBy("cv_id", "job_id").agg(F.sort_array(F.collect_list("skill")).alias("tech_stack"))
    job = F.struct("job_id", F.lit("C").alias("company"), "start", "end", "tech_stack")
    work = t.raw_employment.join(stacks, ["cv_id", "job_id"], "left").groupBy("cv_id").agg(F.sort_array(F.collect_list(job)).alias("work_experience"))
    applied = t.applications.groupBy("cv_id").agg(F.sort_array(F.collect_list("jd_id")).alias("jd_ids"))
    degree = [F.struct(F.lit("U").alias("institution"), F.col(c).alias("degree")) for c in ("degree_text", "second_degree_text")]
    record = F.struct(
        "cv_id", "jd_ids", "embedding", F.lit(True).alias("is_resume"), "name", "skills", "work_experience", F.array(*degree).alias("education"),
        F.array("language").alias("languages"), F.struct(F.col("city_text").alias("city"), "raw_address", "willing_to_relocate").alias("candidate_location"),
    )
    whole = t.raw_candidates
    for side in (skills, work, applied, t.cv_vectors):
        whole = whole.join(side, "cv_id", "left")
    line = whole.select("cv_id", F.to_json(record).alias("value"))
    cut = line.where("cv_id % 25 = 4").select(F.expr("left(value, length(value) - 2)").alias("value"))
    return line.select("value").union(cut)


@query("T1_streamed_scoring", o.sql("SELECT cv_id, jd_id, final_score FROM scores"))
def _(t: Tables) -> DataFrame:
    """Records arrive as JSON lines and are scored against prepared jobs, batch by batch."""
    root = new_folder(t.spark)
    arriving_records(t).repartition(4).write.text(f"{root}/arrivals")
    side = scoring_stream.JobSide(t.jobs, t.requirements, t.aliases, t.implies, t.jd_vectors, t.routes, t.gazetteer).written()
    lines = scoring_stream.line_stream(t.spark, f"{root}/arrivals", files_per_batch=2)
    path = scoring_stream.score_arrivals(lines, side, AS_OF, f"{root}/stream")
    return t.spark.read.parquet(f"{path}/scores").select("cv_id", "jd_id", "final_score")


@query(
    "T2_running_unknown_counts",
    o.sql("""
      WITH strange AS (
        SELECT token FROM token_facts WHERE NOT found AND framework IS NULL AND token NOT IN (
          SELECT a FROM unknown_ratio WHERE ratio >= 0.85))
      SELECT token AS skill, count(DISTINCT coalesce(nullif(name, ''), 'unknown_cv')) AS cv_count, '2001-09-' ||
        printf('%02d', max(cv_id % 28 + 1)::INT) AS last_seen
      FROM tokens JOIN strange USING (token) JOIN raw_candidates USING (cv_id) GROUP BY token"""),
)
def _(t: Tables) -> DataFrame:
    """Tokens of candidates arrive in several batches; the log ends as the batch query has it."""
    root = new_folder(t.spark)
    sightings = t.screening.tokens.join(sighted(t), "cv_id").select("token", "cv_name", "seen_on")
    sightings.repartition(4).write.parquet(f"{root}/sightings")
    stream = t.spark.readStream.schema(sightings.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/sightings")
    aliases = materialise(t.aliases)
    path = skill_log.run_log(stream, aliases, path=f"{root}/log")
    return skill_log.read_log(t.spark.read.parquet(path), aliases)
