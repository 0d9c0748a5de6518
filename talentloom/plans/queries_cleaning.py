"""Reading and normalising records and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.constants import MAX_URLS_PER_BATCH, WHITESPACE_CLASS
from talentloom.functions import cleaning, text
from talentloom.functions.months import months_between, parse_month
from talentloom.functions.strings import strip
from talentloom.operators.evaluation import extraction_gaps, is_valid_candidate
from talentloom.plans import oracle as o
from talentloom.plans.registry import query
from talentloom.sources import records
from talentloom.sources.tables import AS_OF, Tables, record_json


def parsed(t: Tables) -> DataFrame:
    return records.parse_records(record_json(t), "body", records.CANDIDATE_SCHEMA)


def clean_records(t: Tables) -> DataFrame:
    """Records without error, opened by a generator: a filter would be pushed below the parser and parse again."""
    good = parsed(t).select("cv_id", F.inline(F.array_compact(F.array("record"))))
    return records.normalise_candidates(good, AS_OF)


# Customers whose JSON text is complete, with the columns their records derive from.
_GOOD = "raw_candidates JOIN customer ON c_custkey = cv_id WHERE cv_id % 25 <> 4"


@query(
    "S1_record_ingest",
    o.sql("""
      SELECT cv_id, CASE WHEN cv_id % 25 = 4 THEN 'invalid JSON' ELSE '' END AS error,
        cv_id % 25 <> 4 AND cv_id % 10 = 3 AS repaired,
        CASE WHEN cv_id % 25 = 4 THEN '' ELSE name END AS name
      FROM raw_candidates"""),
)
def _(t: Tables) -> DataFrame:
    return parsed(t).select(
        "cv_id",
        F.coalesce("error", F.lit("")).alias("error"),
        "repaired",
        F.coalesce("record.name", F.lit("")).alias("name"),
    )


@query(
    "S6_error_isolation",
    o.sql("""
      SELECT CASE WHEN cv_id % 25 = 4 THEN 'invalid JSON'
          WHEN NOT is_resume THEN 'not a resume' ELSE '' END AS error, count(*) AS n
      FROM raw_candidates GROUP BY 1"""),
)
def _(t: Tables) -> DataFrame:
    error = F.coalesce("error", F.when(~F.col("record.is_resume"), "not a resume"), F.lit(""))
    return parsed(t).groupBy(error.alias("error")).agg(F.count("*").alias("n"))


@query(
    "S8_job_text_detection",
    f"""
      SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '' ELSE md5({o.strip('text')}) END AS digest,
        CASE doc_id % 4 WHEN 3 THEN 'jd_text is empty' ELSE '' END AS error
      FROM documents""",
)
def _(t: Tables) -> DataFrame:
    """Bodies alternate: plain text, an object with the text, an object with an empty text."""
    docs = t.read("documents", "doc_id", "text")
    wrapped = F.to_json(F.struct(F.col("text").alias("jd_text")))
    body = F.when(F.col("doc_id") % 4 == 3, F.lit('{"jd_text": "  "}')).when(
        F.col("doc_id") % 4 == 1, wrapped
    ).otherwise(F.col("text"))
    found = records.job_text(F.col("body"))
    return docs.withColumn("body", body).select(
        "doc_id",
        F.when(found["jd_text"] == "", "").otherwise(F.md5(found["jd_text"])).alias("digest"),
        F.coalesce(found["error"], F.lit("")).alias("error"),
    )


@query(
    "P1_parse_month",
    o.sql(f"""
      SELECT job_id, CAST(coalesce({o.month('start_text')}, -1) AS BIGINT) AS start_m,
        CAST(coalesce({o.month('end_text')}, -1) AS BIGINT) AS end_m FROM raw_employment"""),
)
def _(t: Tables) -> DataFrame:
    return t.raw_employment.select(
        "job_id",
        F.coalesce(parse_month("start", AS_OF), F.lit(-1)).cast("bigint").alias("start_m"),
        F.coalesce(parse_month("end", AS_OF), F.lit(-1)).cast("bigint").alias("end_m"),
    )


@query(
    "P2_month_difference",
    o.sql(f"""
      SELECT job_id, CAST(greatest(coalesce({o.month('end_text')}, {o.NOW}) - coalesce({o.month('start_text')}, {o.NOW}), 0)
        AS BIGINT) AS months FROM raw_employment"""),
)
def _(t: Tables) -> DataFrame:
    return t.raw_employment.select(
        "job_id", months_between("start", "end", AS_OF).cast("bigint").alias("months")
    )


@query(
    "P3_job_completion",
    o.sql(f"""
      SELECT cv_id, 0::BIGINT AS pos, cv_id % 2 = 0 AS is_current,
        CAST(CASE WHEN cv_id % 3 = 0 THEN 7 ELSE greatest(
          (CASE WHEN cv_id % 2 = 0 THEN {o.NOW} ELSE 24016 END) - (24000 + cv_id % 9), 0) END AS BIGINT) AS months
      FROM {_GOOD} AND (cv_id % 4 <> 0 OR cv_id % 5 <> 0 OR cv_id % 3 <> 0)
      UNION ALL
      SELECT cv_id, CASE WHEN cv_id % 4 <> 0 OR cv_id % 5 <> 0 OR cv_id % 3 <> 0 THEN 1 ELSE 0 END, false, 12
      FROM {_GOOD}"""),
)
def _(t: Tables) -> DataFrame:
    return records.flat_employment(clean_records(t)).select(
        "cv_id", F.col("job_id").cast("bigint").alias("pos"), "is_current", F.col("months").cast("bigint").alias("months")
    )


@query(
    "P4_P5_degree",
    o.sql(f"""
      SELECT cv_id, coalesce({o.degree('degree_text')}, '') AS degree,
        CAST({o.rank(f"({o.degree('degree_text')})")} AS BIGINT) AS degree_rank FROM raw_candidates"""),
)
def _(t: Tables) -> DataFrame:
    level = cleaning.degree("degree_text")
    return t.raw_candidates.select(
        "cv_id",
        F.coalesce(level, F.lit("")).alias("degree"),
        cleaning.degree_rank(level).cast("bigint").alias("degree_rank"),
    )


@query("P6_candidate_city", o.sql("SELECT cv_id, coalesce(city, '') AS city FROM candidates"))
def _(t: Tables) -> DataFrame:
    return t.raw_candidates.select(
        "cv_id", F.coalesce(cleaning.candidate_city("city_text"), F.lit("")).alias("city")
    )


@query(
    "P7_P8_P9_P13_job_fields",
    o.sql("""
      SELECT jd_id, city, work_mode, CAST(min_years AS BIGINT) AS min_years, coalesce(degree, '') AS degree FROM jobs"""),
)
def _(t: Tables) -> DataFrame:
    return t.raw_jobs.select(
        "jd_id",
        cleaning.job_city("city_text").alias("city"),
        cleaning.work_mode("work_mode_text").alias("work_mode"),
        cleaning.min_years("min_years_text").cast("bigint").alias("min_years"),
        F.coalesce(cleaning.job_degree("education_text"), F.lit("")).alias("degree"),
    )


@query(
    "P10_P11_P15_record_cleaning",
    o.sql(f"""
      SELECT cv_id, name, summary, 'Go|' || lower(c_mktsegment) AS skills,
        CASE WHEN cv_id % 4 <> 0 OR cv_id % 5 <> 0 OR cv_id % 3 <> 0 THEN 2 ELSE 1 END::BIGINT AS n_jobs,
        1::BIGINT AS n_education, 'P' || cv_id AS projects, 'AWS|CKA|PMP' AS certifications,
        coalesce(raw_address, '') AS raw_address
      FROM {_GOOD}"""),
)
def _(t: Tables) -> DataFrame:
    return clean_records(t).select(
        "cv_id", "name", "summary",
        F.array_join("skills", "|").alias("skills"),
        F.size("work_experience").cast("bigint").alias("n_jobs"),
        F.size("education").cast("bigint").alias("n_education"),
        F.array_join("projects.name", "|").alias("projects"),
        F.array_join("certifications", "|").alias("certifications"),
        F.coalesce("candidate_location.raw_address", F.lit("")).alias("raw_address"),
    )


@query(
    "P12_P16_alternatives_and_names",
    o.sql("""
      SELECT jd_id, CAST(count(*) AS BIGINT) AS n_names, string_agg(name, '|' ORDER BY req_pos, alt_pos) AS names
      FROM requirements GROUP BY jd_id"""),
)
def _(t: Tables) -> DataFrame:
    """A job's list is short by nature, so gathering it per job is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("req_pos", "alt_pos", "name")))["name"]
    return t.requirements.groupBy("jd_id").agg(
        F.count("*").alias("n_names"), F.array_join(ordered, "|").alias("names")
    )


@query(
    "P14_generic_skills",
    o.sql(f"""
      SELECT jd_id, CAST(req_pos AS BIGINT) AS req_pos, CAST(alt_pos AS BIGINT) AS alt_pos, {o.skill_key('name')} AS skill_key,
        {o.skill_key('name')} IN ({o._GENERIC}) AS is_generic
      FROM raw_requirements"""),
)
def _(t: Tables) -> DataFrame:
    return t.raw_requirements.select(
        "jd_id",
        F.col("req_pos").cast("bigint").alias("req_pos"),
        F.col("alt_pos").cast("bigint").alias("alt_pos"),
        cleaning.skill_key("name").alias("skill_key"),
        cleaning.is_generic_skill("name").alias("is_generic"),
    )


@query(
    "P17_D4a_current_role",
    o.sql(f"""
      SELECT cv_id, CASE WHEN cv_id % 2 = 0 AND (cv_id % 4 <> 0 OR cv_id % 5 <> 0 OR cv_id % 3 <> 0) THEN 'Dev' ELSE '' END AS role,
        CAST({o.rank(f"({o.degree('degree_text')})")} AS BIGINT) AS degree_rank
      FROM {_GOOD}"""),
)
def _(t: Tables) -> DataFrame:
    return clean_records(t).select(
        "cv_id",
        F.coalesce(records.current_role("work_experience"), F.lit("")).alias("role"),
        records.highest_degree_rank("education").cast("bigint").alias("degree_rank"),
    )


@query(
    "P18_candidate_narrative",
    o.sql(f"""
      SELECT cv_id, concat_ws(chr(10), nullif(summary, ''),
        CASE WHEN cv_id % 4 <> 0 OR cv_id % 5 <> 0 OR cv_id % 3 <> 0 THEN 'Dev at ' ||
          (CASE WHEN cv_id % 4 = 0 THEN '' ELSE 'C' || cv_id END) ||
          (CASE WHEN cv_id % 5 = 0 THEN '' ELSE ': Built things' END) END,
        'Intern at Old Co',
        'Project: P' || cv_id || (CASE WHEN cv_id % 7 = 0 THEN '' ELSE ' Fun' END),
        degree_text || ' at U major M' || (cv_id % 6),
        'Certifications: AWS, CKA, PMP', 'Languages: ' || language) AS narrative
      FROM {_GOOD}"""),
)
def _(t: Tables) -> DataFrame:
    return clean_records(t).select("cv_id", records.narrative_text(AS_OF).alias("narrative"))


@query(
    "P19_job_narrative",
    o.sql("""
      SELECT jd_id, concat_ws(chr(10), title, nullif(responsibilities, ''),
        CASE WHEN min_years > 0 THEN 'Experience: minimum ' || min_years || ' years' END,
        CASE WHEN degree IS NOT NULL THEN 'Education: ' ||
          (CASE degree WHEN 'high_school' THEN 'High School' ELSE upper(left(degree, 1)) || substr(degree, 2) END) || ' or above' END) AS narrative
      FROM jobs"""),
)
def _(t: Tables) -> DataFrame:
    return t.jobs.select(
        "jd_id",
        text.job_narrative(
            F.col("title"), F.col("responsibilities"), F.col("min_years"), F.col("degree")
        ).alias("narrative"),
    )


_CLEAN = o.strip(
    "regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
)


@query("P20_clean_text", f"SELECT doc_id, md5({_CLEAN}) AS digest, length({_CLEAN}) AS n_chars FROM documents")
def _(t: Tables) -> DataFrame:
    cleaned = text.clean_text("text")
    return t.read("documents", "doc_id", "text").select(
        "doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("bigint").alias("n_chars")
    )


@query(
    "P21_text_quality",
    r"""
      SELECT doc_id, greatest(100 - 60 * short - 30 * few - 20 * noisy - 15 * odd, 0)::BIGINT AS score,
        concat_ws('; ', CASE short WHEN 1 THEN 'text too short' END, CASE few WHEN 1 THEN 'too few words' END,
          CASE noisy WHEN 1 THEN 'high garbage char ratio' END,
          CASE odd WHEN 1 THEN 'abnormal avg word length ' || printf('%.1f', mean) END) AS reasons,
        words::BIGINT AS word_count, greatest(100 - 60 * short - 30 * few - 20 * noisy - 15 * odd, 0) < 60 AS needs_fallback
      FROM (
        SELECT *, (chars < 100)::INT AS short, (words < 30)::INT AS few,
          (chars > 0 AND garbage / greatest(chars, 1) > 0.02)::INT AS noisy,
          (words > 0 AND (mean < 2 OR mean > 15))::INT AS odd
        FROM (
          SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, chr(65533), '')) AS garbage,
            len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words,
            list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(w)))
              / nullif(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 0)::DOUBLE AS mean
          FROM documents))""",
)
def _(t: Tables) -> DataFrame:
    quality = text.text_quality("text")
    return t.read("documents", "doc_id", "text").select(
        "doc_id",
        quality["score"].cast("bigint").alias("score"),
        quality["reasons"].alias("reasons"),
        quality["word_count"].cast("bigint").alias("word_count"),
        cleaning.needs_fallback(quality["score"]).alias("needs_fallback"),
    )


WORDS = f"len(regexp_extract_all(text, {o.quote('[^' + WHITESPACE_CLASS.replace('{85}', '{0085}').replace('{a0}', '{00a0}') + ']+')}))"


@query(
    "P22_text_statistics",
    f"""
      SELECT conv_id, turn, length(text)::BIGINT AS chars, {WORDS}::BIGINT AS words,
        greatest(len(regexp_extract_all(text, '[.!?]')), 1)::BIGINT AS sentences FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    stats = text.text_stats("text")
    return t.read("conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", *[c.cast("bigint").alias(name) for name, c in stats.items()]
    )


def postings(t: Tables) -> DataFrame:
    """Each hiring job written out as labelled text. Lists per job are short."""

    def names(tier: str) -> Column:
        picked = F.collect_list(F.when(F.col("tier") == tier, F.struct("req_pos", "alt_pos", "name")))
        return F.array_join(F.array_sort(picked)["name"], ", ")

    lists = t.requirements.groupBy("jd_id").agg(
        names("required").alias("required"), names("preferred").alias("preferred"), names("nice_to_have").alias("nice")
    )
    j = t.raw_jobs.join(lists, "jd_id", "left")
    education = F.when(F.col("jd_id") % 3 == 0, "Thạc sĩ, Đại học").when(F.col("jd_id") % 3 == 1, "Tiến sĩ").otherwise("")
    experience = F.when(F.col("min_years_text") == "3", "3-5 years").when(
        F.col("min_years_text") == "6", "at least 6 years"
    ).otherwise("Fresher")
    return j.select(
        "jd_id",
        text.job_posting_text(
            F.col("title"), strip("work_mode_text"),
            F.concat_ws(", ", F.nullif("raw_address", F.lit("")), "city_text"),
            education, F.col("required"), F.col("preferred"), F.col("nice"), experience,
            F.col("responsibilities"), F.lit(""), F.lit("  Tea  "),
        ).alias("posting"),
    )


_LISTS = """(
  SELECT jd_id, string_agg(name, ', ' ORDER BY req_pos, alt_pos) FILTER (tier = 'required') AS required,
    string_agg(name, ', ' ORDER BY req_pos, alt_pos) FILTER (tier = 'preferred') AS preferred,
    string_agg(name, ', ' ORDER BY req_pos, alt_pos) FILTER (tier = 'nice_to_have') AS nice
  FROM requirements GROUP BY jd_id)"""


@query(
    "P23_posting_text",
    o.sql(f"""
      SELECT jd_id, concat_ws(chr(10) || chr(10), 'Job Title: ' || title, 'Work Type: ' || trim(work_mode_text),
        'Location: ' || concat_ws(', ', nullif(raw_address, ''), city_text),
        'Education: ' || CASE jd_id % 3 WHEN 0 THEN 'Thạc sĩ, Đại học' WHEN 1 THEN 'Tiến sĩ' END,
        'Required Skills: ' || required, 'Preferred Skills: ' || preferred, 'Nice to Have Skills: ' || nice,
        'Experience Requirement: ' || CASE min_years_text WHEN '3' THEN '3-5 years' WHEN '6' THEN 'at least 6 years' ELSE 'Fresher' END,
        'Responsibilities:' || chr(10) || nullif(responsibilities, ''), 'Benefits:' || chr(10) || 'Tea') AS posting
      FROM raw_jobs LEFT JOIN {_LISTS} USING (jd_id)"""),
)
def _(t: Tables) -> DataFrame:
    return postings(t)


@query(
    "P24_posting_fields",
    o.sql(f"""
      SELECT jd_id, title, CASE jd_id % 4 WHEN 1 THEN 'hybrid' WHEN 2 THEN 'remote' ELSE 'onsite' END AS work_mode,
        city_text, raw_address, CASE jd_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 0 END::BIGINT AS education_rank,
        coalesce(replace(required, ', ', '|'), '') AS required, coalesce(replace(preferred, ', ', '|'), '') AS preferred,
        coalesce(replace(nice, ', ', '|'), '') AS nice,
        CASE min_years_text WHEN '3' THEN 3 WHEN '6' THEN 6 ELSE 0 END::BIGINT AS min_years
      FROM raw_jobs LEFT JOIN {_LISTS} USING (jd_id)"""),
)
def _(t: Tables) -> DataFrame:
    fields = text.tagged_fields("posting")
    return postings(t).select(
        "jd_id", fields["title"].alias("title"), fields["work_mode"].alias("work_mode"),
        fields["city_text"].alias("city_text"), fields["raw_address"].alias("raw_address"),
        fields["education_rank"].cast("bigint").alias("education_rank"),
        F.array_join(fields["required_skills"], "|").alias("required"),
        F.array_join(fields["preferred_skills"], "|").alias("preferred"),
        F.array_join(fields["nice_to_have_skills"], "|").alias("nice"),
        fields["min_years"].cast("bigint").alias("min_years"),
    )


@query(
    "P25_url_validation",
    f"""
      SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_valid,
        count(*) OVER (PARTITION BY page_id // 60) <= {MAX_URLS_PER_BATCH} AS batch_ok
      FROM pages""",
)
def _(t: Tables) -> DataFrame:
    """Batches of sixty pages; the size is counted, not collected."""
    pages = t.read("pages", "page_id", "url").withColumn("batch", F.floor(F.col("page_id") / 60))
    sizes = pages.groupBy("batch").agg((F.count("*") <= MAX_URLS_PER_BATCH).alias("batch_ok"))
    return pages.join(sizes, "batch").select("page_id", cleaning.url_is_valid("url").alias("is_valid"), "batch_ok")


_URL_NAME = "string_split(rtrim(string_split(url, '?')[1], '/'), '/')[-1]"


@query(
    "P26_P27_P28_filenames",
    f"""
      SELECT page_id, name, CASE WHEN string_split(lower(name), '.')[-1] = 'pdf' THEN 'pdf'
        WHEN string_split(lower(name), '.')[-1] IN ('docx', 'doc') THEN 'docx' ELSE 'unsupported' END AS route
      FROM (
        SELECT page_id, CASE WHEN contains(base, '.') THEN base WHEN page_id % 2 = 0 THEN base || '.docx' ELSE base || '.pdf' END AS name
        FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'cv ' || page_id || '.PDF' WHEN 1 THEN 'cv' || page_id ELSE {_URL_NAME} END AS base
              FROM pages))""",
)
def _(t: Tables) -> DataFrame:
    page = F.col("page_id")
    pages = t.read("pages", "page_id", "url").select(
        "page_id",
        "url",
        F.when(page % 5 == 0, F.concat(F.lit('attachment; filename="cv '), page.cast("string"), F.lit('.PDF"; size=1')))
        .when(page % 5 == 1, F.concat(F.lit("attachment; filename*=UTF-8''cv"), page.cast("string")))
        .alias("disposition"),
        F.when(page % 2 == 0, "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .otherwise("application/pdf")
        .alias("content_type"),
    )
    named = pages.select("page_id", cleaning.filename("url", "disposition", "content_type").alias("name"))
    return named.withColumn("route", cleaning.file_route("name"))


@query(
    "P29_score_band",
    "SELECT event_id, CASE WHEN value >= 80 THEN 'success' WHEN value >= 60 THEN 'warning' ELSE 'error' END AS band FROM events",
)
def _(t: Tables) -> DataFrame:
    return t.read("events", "event_id", "value").select("event_id", cleaning.score_band("value").alias("band"))


def weight_configs(t: Tables) -> DataFrame:
    """(jd_id, weights): valid, missing, badly summed, out of range, or short of a key."""
    k = F.col("s_suppkey") % 5

    def weights(a: float, b: float, c: float, d: float, e: float) -> Column:
        names = ("semantic", "skills", "experience", "education", "location")
        return F.create_map(*[F.lit(v) for pair in zip(names, (a, b, c, d, e)) for v in pair])

    return t.read("supplier", "s_suppkey").select(
        F.col("s_suppkey").alias("jd_id"),
        F.when(k == 0, weights(0.2, 0.4, 0.2, 0.1, 0.1))
        .when(k == 1, weights(0.2, 0.3, 0.2, 0.1, 0.1))
        .when(k == 2, weights(1.2, -0.2, 0.0, 0.0, 0.0))
        .when(k == 3, F.create_map(F.lit("skills"), F.lit(1.0)))
        .alias("weights"),
    )


@query(
    "P30_P31_F3_weights",
    """
      SELECT s_suppkey AS jd_id, CASE s_suppkey % 5 WHEN 1 THEN 'sum' WHEN 2 THEN 'range' WHEN 3 THEN 'keys' ELSE '' END AS problem,
        CASE WHEN s_suppkey % 5 = 0 THEN 0.2 ELSE 0.3 END::DOUBLE AS w_semantic,
        CASE WHEN s_suppkey % 5 = 0 THEN 0.4 ELSE 0.3 END::DOUBLE AS w_skills
      FROM supplier""",
)
def _(t: Tables) -> DataFrame:
    checked = weight_configs(t).withColumn("problem", F.coalesce(cleaning.weights_problem("weights"), F.lit("")))
    used = cleaning.weights_used(F.when(F.col("problem") == "", F.col("weights")))
    return checked.select(
        "jd_id", "problem", used["semantic"].alias("w_semantic"), used["skills"].alias("w_skills")
    )


@query(
    "P32_range_check",
    "SELECT event_id, value FROM events WHERE NOT coalesce(value BETWEEN 0 AND 100, false)",
)
def _(t: Tables) -> DataFrame:
    return t.read("events", "event_id", "value").filter(~cleaning.scores_in_range("value"))


@query(
    "P33_bulk_list_split",
    f"""
      SELECT conv_id, turn, line FROM (
        SELECT conv_id, turn, {o.strip('line')} AS line FROM (
          SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations))
      WHERE line <> ''""",
)
def _(t: Tables) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    return t.read("conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", F.explode(lines).alias("line")
    )


@query(
    "P34_request_completeness",
    """
      SELECT c_custkey AS request_id, CASE WHEN c_custkey % 6 = 0 THEN 'name is required'
        WHEN c_custkey % 6 = 1 THEN 'jdText is required'
        WHEN c_custkey % 6 = 2 THEN 'cvUrls must be a non-empty array' ELSE '' END AS problem
      FROM customer""",
)
def _(t: Tables) -> DataFrame:
    from talentloom.operators.batches import request_problem

    k = F.col("c_custkey") % 6
    problem = request_problem(
        F.when(k == 0, " \n").otherwise(F.col("c_name")),
        F.when(k == 1, "\t").otherwise(F.col("c_mktsegment")),
        F.when(k == 2, 0).otherwise(3),
    )
    return t.read("customer", "c_custkey", "c_name", "c_mktsegment").select(
        F.col("c_custkey").alias("request_id"), F.coalesce(problem, F.lit("")).alias("problem")
    )


@query(
    "E6_E8_validity_and_gaps",
    o.sql(f"""
      SELECT cv_id, is_resume AS is_valid, false AS needs_jobs, is_resume AND contains(c_mktsegment, 'U') AS needs_skills
      FROM {_GOOD}"""),
)
def _(t: Tables) -> DataFrame:
    """Skills of one segment are blanked to leave something to extract again."""
    segments = t.read("customer", "c_custkey", "c_mktsegment")
    c = clean_records(t).join(segments, F.col("cv_id") == F.col("c_custkey"))
    skills = F.when(F.col("c_mktsegment").contains("U"), 0).otherwise(F.size("skills"))
    jobs = F.size("work_experience")
    needs_jobs, needs_skills = extraction_gaps(F.col("is_resume"), jobs, skills)
    return c.select(
        "cv_id",
        is_valid_candidate(
            F.col("is_resume"), F.col("name"), skills, jobs, F.size("education"), F.size("projects")
        ).alias("is_valid"),
        needs_jobs.alias("needs_jobs"),
        needs_skills.alias("needs_skills"),
    )
