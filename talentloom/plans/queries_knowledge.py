"""Skill names, tokens and the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.functions.skills import credential_tokens, proficiency, spelling_variants
from talentloom.functions.strings import strip
from talentloom.operators import fuzzy, knowledge, matching, resolve, variants
from talentloom.plans import oracle as o
from talentloom.plans.registry import query
from talentloom.session import new_folder
from talentloom.sources import knowledge_files
from talentloom.sources.tables import Tables


def all_names(t: Tables) -> DataFrame:
    return (
        t.screening.tokens.select(F.col("token").alias("name"))
        .union(t.requirements.select("name"))
        .union(t.cv_skills.select("skill"))
        .distinct()
    )


@query(
    "K1_spelling_variants",
    o.sql(f"""
      SELECT name, string_agg(alias, '|' ORDER BY pos) AS variants FROM (
        SELECT name, alias, min(pos) AS pos FROM spelled WHERE alias <> '' GROUP BY 1, 2)
      GROUP BY name"""),
)
def _(t: Tables) -> DataFrame:
    return all_names(t).select("name", F.array_join(spelling_variants("name"), "|").alias("variants"))


@query("K2_K3_canonical_names", o.sql("SELECT name, canonical, found, matched_key, kind FROM resolved"))
def _(t: Tables) -> DataFrame:
    return resolve.resolve_names(all_names(t), t.aliases)


@query(
    "K4_credential_tokens",
    o.sql(f"""
      SELECT DISTINCT cv_id, token FROM (
        SELECT cv_id, lower({o.strip('text')}) AS token FROM credentials
        UNION ALL SELECT cv_id, {o.strip('part')} FROM (
          SELECT cv_id, unnest(regexp_split_to_array(lower(text), '[-–—:,/()]+')) AS part FROM credentials))
      WHERE token <> ''"""),
)
def _(t: Tables) -> DataFrame:
    return t.credentials.select("cv_id", F.explode(credential_tokens("text")).alias("token"))


@query("K5_A31_candidate_tokens", o.sql("SELECT cv_id, token FROM tokens"))
def _(t: Tables) -> DataFrame:
    return t.screening.tokens


@query(
    "K6_candidate_context",
    o.sql("""
      SELECT cv_id, canonical AS skill, 1::BIGINT AS layer, min(token) AS via
      FROM tokens JOIN token_facts USING (token) GROUP BY 1, 2
      UNION ALL
      SELECT cv_id, dst, 2, min(token) FROM tokens JOIN token_facts USING (token) JOIN implies ON src = canonical GROUP BY 1, 2"""),
)
def _(t: Tables) -> DataFrame:
    s = t.screening
    context = matching.context(s.tokens, s.facts, t.implies, ["cv_id"])
    return context.select("cv_id", "skill", F.col("layer").cast("bigint").alias("layer"), "via")


@query(
    "K7_proficiency",
    o.sql(f"""
      SELECT token, coalesce(framework, '') AS framework, coalesce(rank, -1)::DOUBLE AS rank FROM token_facts"""),
)
def _(t: Tables) -> DataFrame:
    level = proficiency("token")
    return t.screening.tokens.select("token").distinct().select(
        "token",
        F.coalesce(level["framework"], F.lit("")).alias("framework"),
        F.coalesce(level["rank"], F.lit(-1.0)).alias("rank"),
    )


@query(
    "K8_J5_fuzzy_pairs",
    o.sql("SELECT a AS name, b AS token, round(ratio, 9) AS ratio FROM ro_ratio WHERE ratio >= 0.85"),
)
def _(t: Tables) -> DataFrame:
    """Required names that are no proficiency level, against all candidate tokens."""
    name = F.lower(strip("name"))
    names = t.requirements.select(name.alias("name")).distinct().filter(proficiency("name").isNull())
    tokens = t.screening.tokens.select(F.col("token").alias("name")).distinct()
    return fuzzy.fuzzy_pairs(names, tokens).filter("a <> b").select(
        F.col("a").alias("name"), F.col("b").alias("token"), F.round("ratio", 9).alias("ratio")
    )


@query(
    "K8_best_fuzzy_match",
    o.sql("""
      SELECT a AS name, b AS token, round(ratio, 9) AS ratio FROM ro_ratio WHERE ratio >= 0.85
        AND a NOT IN (SELECT token FROM token_facts)
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY ratio DESC, b) = 1"""),
)
def _(t: Tables) -> DataFrame:
    """The nearest token of names that are no token themselves."""
    name = F.lower(strip("name"))
    tokens = t.screening.tokens.select(F.col("token").alias("name")).distinct()
    names = t.requirements.select(name.alias("name")).distinct().filter(proficiency("name").isNull())
    best = fuzzy.best_fuzzy(names.join(tokens, "name", "left_anti"), tokens)
    return best.select(F.col("a").alias("name"), F.col("b").alias("token"), F.round("ratio", 9).alias("ratio"))


@query(
    "K9_group_labels",
    o.sql("""
      SELECT jd_id, tier, req_pos::BIGINT AS req_pos, weight::BIGINT AS weight, label FROM groups"""),
)
def _(t: Tables) -> DataFrame:
    return t.screening.groups.select(
        "jd_id", "tier", F.col("req_pos").cast("bigint").alias("req_pos"), F.col("weight").cast("bigint").alias("weight"), "label"
    )


@query(
    "K10_picker_vocabulary",
    o.sql(f"""
      SELECT skill FROM (
        SELECT {o.strip('name')} AS skill FROM raw_requirements
        QUALIFY row_number() OVER (PARTITION BY lower({o.strip('name')}) ORDER BY jd_id DESC, req_pos DESC, alt_pos DESC) = 1)
      WHERE skill <> ''"""),
)
def _(t: Tables) -> DataFrame:
    """One spelling per lower-case key: the last one listed."""
    listed = t.raw_requirements.withColumn("skill", strip("name")).filter("skill <> ''")
    return (
        listed.groupBy(F.lower("skill").alias("key"))
        .agg(F.max_by("skill", F.struct("jd_id", "req_pos", "alt_pos")).alias("skill"))
        .select("skill")
    )


def sighted(t: Tables) -> DataFrame:
    """(cv_id, cv_name, seen_on): under which name and when a candidate came in."""
    return t.raw_candidates.select(
        "cv_id",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("unknown_cv")).alias("cv_name"),
        F.format_string("2001-09-%02d", (F.col("cv_id") % 28 + 1).cast("int")).alias("seen_on"),
    )


@query(
    "K11_B11_unknown_skills",
    o.sql("""
      WITH strange AS (
        SELECT token FROM token_facts WHERE NOT found AND framework IS NULL AND token NOT IN (
          SELECT a FROM unknown_ratio WHERE ratio >= 0.85))
      SELECT token AS skill, count(DISTINCT coalesce(nullif(name, ''), 'unknown_cv')) AS cv_count, '2001-09-' ||
        printf('%02d', max(cv_id % 28 + 1)::INT) AS last_seen
      FROM tokens JOIN strange USING (token) JOIN raw_candidates USING (cv_id) GROUP BY token"""),
)
def _(t: Tables) -> DataFrame:
    return matching.unknown_skills(t.screening.tokens, t.aliases, sighted(t))


@query("B1_alias_table", o.sql("SELECT alias, coalesce(canonical, '') AS canonical FROM aliases"))
def _(t: Tables) -> DataFrame:
    return t.aliases.select("alias", F.coalesce("canonical", F.lit("")).alias("canonical"))


@query("B2_tag_filter", o.sql("SELECT name, has_synonyms FROM tags WHERE NOT in_collective"))
def _(t: Tables) -> DataFrame:
    return knowledge.without_collectives(t.tags).select("name", "has_synonyms")


def additions(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New canonicals (brands), aliases (types, and one clash per tag), edges brand -> tag in part order."""
    part = t.read("part", "p_partkey", "p_name", "p_brand", "p_type")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    tag = F.replace("p_name", F.lit(" "), F.lit("-"))
    canonicals = part.select(brand.alias("skill")).distinct()
    kinds = part.groupBy(F.lower("p_type").alias("alias")).agg(F.min(brand).alias("canonical"))
    clashes = part.groupBy(tag.alias("alias")).agg(F.min(brand).alias("canonical"))
    edges = part.groupBy(brand.alias("src"), tag.alias("dst")).agg(F.min("p_partkey").alias("pos"))
    return canonicals, kinds.union(clashes), edges


def published(t: Tables) -> knowledge_files.KnowledgeBase:
    """The maps of the tables as the first version of a knowledge base in files."""
    base = knowledge_files.KnowledgeBase(t.spark, new_folder(t.spark))
    base.publish(t.aliases, t.edges.withColumn("pos", F.lit(0).cast("bigint")))
    return base


def merged(t: Tables) -> knowledge_files.KnowledgeBase:
    """The additions that pass the gate as the second version: edges need two canonical ends."""
    base = published(t)
    canonicals, new_aliases, new_edges = additions(t)
    known = knowledge.canonical_skills(knowledge.merge_aliases(t.aliases, canonicals, new_aliases.limit(0)))
    for end in ("src", "dst"):
        new_edges = new_edges.join(known.withColumnRenamed("skill", end), end, "left_semi")
    base.merge(canonicals, new_aliases, new_edges)
    return base


_ADDED = """
  added_brands AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS skill FROM part),
  added_aliases AS (
    SELECT lower(p_type) AS alias, min(lower(replace(p_brand, '#', '-'))) AS canonical FROM part GROUP BY 1
    UNION ALL SELECT replace(p_name, ' ', '-'), min(lower(replace(p_brand, '#', '-'))) FROM part GROUP BY 1),
  added_edges AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS src, replace(p_name, ' ', '-') AS dst FROM part),
  known AS (
    SELECT alias AS skill FROM aliases WHERE canonical IS NULL OR canonical = alias
    UNION SELECT skill FROM added_brands WHERE skill NOT IN (SELECT alias FROM aliases)),
  later_edges AS (
    SELECT src, dst, min(pos) AS pos FROM (
      SELECT lower(replace(p_brand, '#', '-')) AS src, replace(p_name, ' ', '-') AS dst, p_partkey AS pos FROM part
      WHERE lower(replace(p_brand, '#', '-')) IN (SELECT skill FROM known) AND replace(p_name, ' ', '-') IN (SELECT skill FROM known)
      UNION ALL SELECT alias, canonical, 4611686018427387904 FROM added_aliases
      WHERE alias <> canonical AND alias IN (SELECT alias FROM aliases WHERE canonical IS NULL OR canonical = alias))
    GROUP BY src, dst),
  given AS (
    SELECT src, dst, 0 AS pos FROM edges
    UNION ALL SELECT src, dst, coalesce(behind, 0) + row_number() OVER (PARTITION BY src ORDER BY pos, dst) - 1
    FROM later_edges LEFT JOIN (SELECT src, count(*) AS behind FROM edges GROUP BY src) USING (src)
    WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edges))"""


@query(
    "S2_knowledge_files",
    o.sql(f"""
      SELECT * FROM (WITH {_ADDED}
        SELECT 'alias' AS map, alias AS key, coalesce(canonical, '') AS value, 0 AS pos FROM aliases
        UNION ALL SELECT 'alias', skill, '', 0 FROM added_brands WHERE skill NOT IN (SELECT alias FROM aliases)
        UNION ALL SELECT 'alias', alias, canonical, 0 FROM added_aliases
          WHERE alias NOT IN (SELECT alias FROM aliases) AND alias NOT IN (SELECT skill FROM added_brands)
        UNION ALL SELECT 'implies', src, dst, pos FROM given)"""),
)
def _(t: Tables) -> DataFrame:
    """Both maps of the merged knowledge base, as the files hold them."""
    base = merged(t)
    aliases = base.aliases().select(
        F.lit("alias").alias("map"), F.col("alias").alias("key"), F.coalesce("canonical", F.lit("")).alias("value"), F.lit(0).cast("bigint").alias("pos")
    )
    return aliases.union(base.edges().select(F.lit("implies"), "src", "dst", "pos"))


@query(
    "B3_knowledge_merge",
    o.sql(f"""
      SELECT * FROM (WITH {_ADDED}
        SELECT alias, coalesce(canonical, '') AS canonical FROM aliases
        UNION ALL SELECT skill, '' FROM added_brands WHERE skill NOT IN (SELECT alias FROM aliases)
        UNION ALL SELECT alias, canonical FROM added_aliases
          WHERE alias NOT IN (SELECT alias FROM aliases) AND alias NOT IN (SELECT skill FROM added_brands))"""),
)
def _(t: Tables) -> DataFrame:
    return merged(t).aliases().select("alias", F.coalesce("canonical", F.lit("")).alias("canonical"))


@query(
    "B4_equivalence_edges",
    o.sql(f"""
      SELECT * FROM (WITH {_ADDED}
        SELECT src, dst FROM edges UNION SELECT src, dst FROM added_edges
        UNION SELECT alias, canonical FROM added_aliases
          WHERE alias IN (SELECT alias FROM aliases WHERE canonical IS NULL OR canonical = alias))"""),
)
def _(t: Tables) -> DataFrame:
    _canonicals, new_aliases, new_edges = additions(t)
    edges = knowledge.merge_edges(t.edges, new_edges)
    return knowledge.merge_edges(edges, knowledge.equivalence_edges(t.aliases, new_aliases))


@query(
    "B5_invariant_violations",
    o.sql(f"""
      SELECT * FROM (WITH {_ADDED}
        SELECT 'canonical' AS kind, skill AS name FROM added_brands WHERE skill NOT IN (SELECT skill FROM known)
        UNION SELECT 'alias target', canonical FROM added_aliases WHERE canonical NOT IN (SELECT skill FROM known)
        UNION SELECT 'edge source', src FROM added_edges WHERE src NOT IN (SELECT skill FROM known)
        UNION SELECT 'edge target', dst FROM added_edges WHERE dst NOT IN (SELECT skill FROM known)
        UNION SELECT 'alias clash', n.alias FROM added_aliases n JOIN aliases a ON a.alias = n.alias
          WHERE a.canonical IS DISTINCT FROM n.canonical)"""),
)
def _(t: Tables) -> DataFrame:
    """Why the knowledge base refuses all additions at once; no row if it takes them."""
    base = published(t)
    try:
        base.merge(*additions(t), strict_aliases=True)
    except knowledge_files.MergeRefused as refused:
        return refused.violations
    return t.spark.createDataFrame([], "kind string, name string")


@query("B6_transitive_closure", o.sql("SELECT src, dst FROM implies"))
def _(t: Tables) -> DataFrame:
    return t.implies


@query(
    "B7_closure_order",
    o.sql(f"""
      SELECT src, string_agg(dst, '|' ORDER BY derived, pos, dst) AS targets FROM (WITH RECURSIVE {_ADDED},
          closed AS (SELECT src, dst FROM given UNION SELECT c.src, g.dst FROM closed c JOIN given g ON g.src = c.dst)
        SELECT c.src, c.dst, CASE WHEN g.src IS NULL THEN 1 ELSE 0 END AS derived, coalesce(g.pos, 0) AS pos
        FROM closed c LEFT JOIN given g ON g.src = c.src AND g.dst = c.dst WHERE c.src <> c.dst)
      GROUP BY src"""),
)
def _(t: Tables) -> DataFrame:
    """The merged edges in the order of the file, then what follows from them; only what needs a new edge is worked out anew."""
    edges = merged(t).edges()
    closed = knowledge.extend_closure(t.implies, edges.join(t.edges, ["src", "dst"], "left_anti"))
    ordered = knowledge.closure_in_order(edges, closed)
    return ordered.select("src", F.array_join("targets", "|").alias("targets"))


@query(
    "B8_closure_statistics",
    o.sql("""
      SELECT count(*) AS n_keys, sum(b)::BIGINT AS edges_before, sum(a)::BIGINT AS edges_after, count(*) FILTER (a > b) AS changed_keys
      FROM (SELECT src, count(*) AS b FROM edges GROUP BY 1) JOIN (SELECT src, count(*) AS a FROM implies GROUP BY 1) USING (src)"""),
)
def _(t: Tables) -> DataFrame:
    return knowledge.closure_stats(t.edges, t.implies)


@query(
    "B9_closure_gaps",
    o.sql("""
      SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst
      EXCEPT SELECT src, dst FROM edges"""),
)
def _(t: Tables) -> DataFrame:
    return knowledge.closure_gaps(t.edges)


@query(
    "B10_non_canonical_ends",
    o.sql(f"""
      SELECT * FROM (WITH {_ADDED}
        SELECT DISTINCT side, skill FROM (
          SELECT 'source' AS side, src AS skill FROM added_edges UNION ALL SELECT 'target', dst FROM added_edges)
        WHERE skill NOT IN (SELECT alias FROM aliases WHERE canonical IS NULL OR canonical = alias))"""),
)
def _(t: Tables) -> DataFrame:
    _canonicals, _aliases, new_edges = additions(t)
    return knowledge.non_canonical_edge_ends(new_edges, t.aliases)


@query(
    "J22_expected_implications",
    o.sql("""
      SELECT DISTINCT a.skill AS child, b.skill AS parent, p1.canonical AS child_canonical, p2.canonical AS parent_canonical,
        i.src IS NOT NULL AS found
      FROM cv_skills a JOIN cv_skills b ON b.cv_id = a.cv_id AND b.pos = a.pos + 1
      JOIN resolved p1 ON p1.name = a.skill JOIN resolved p2 ON p2.name = b.skill
      LEFT JOIN implies i ON i.src = p1.canonical AND i.dst = p2.canonical"""),
)
def _(t: Tables) -> DataFrame:
    """Each listed skill against the one listed after it."""
    first = t.cv_skills.select("cv_id", (F.col("pos") + 1).alias("pos"), F.col("skill").alias("child"))
    second = t.cv_skills.select("cv_id", "pos", F.col("skill").alias("parent"))
    pairs = first.join(second, ["cv_id", "pos"]).select("child", "parent").distinct()
    return resolve.implied_by(pairs, t.aliases, t.implies)


def coverage_cases(t: Tables) -> DataFrame:
    """Every written requirement as a lookup case; its category is the part's type."""
    return t.read("part", "p_partkey", "p_type").join(
        written_names(t), "p_partkey"
    ).select(F.col("p_type").alias("category"), "name")


def written_names(t: Tables) -> DataFrame:
    n = t.read("supplier").select(F.count("*")).scalar()
    pos = F.when(F.col("tier") == "required", F.col("req_pos") * 2 + F.col("alt_pos")).otherwise(F.col("req_pos") - 100)
    return t.raw_requirements.select((pos * n + F.col("jd_id")).alias("p_partkey"), "name")


_CASES = f"""(
  SELECT p_type AS category, r.name FROM part JOIN raw_requirements r ON p_partkey % {o._N_SUPPLIER} = r.jd_id
    AND p_partkey // {o._N_SUPPLIER} = CASE r.tier WHEN 'required' THEN r.req_pos * 2 + r.alt_pos ELSE r.req_pos - 100 END)"""


def _found(t: Tables) -> DataFrame:
    cases = coverage_cases(t)
    return cases.join(resolve.resolve_names(cases, t.aliases), "name")


_RESOLVED_RAW = f"""(
  SELECT q.name, count(h.alias) > 0 AS found, coalesce(arg_min(h.self, q.pos) FILTER (h.alias IS NOT NULL), false) AS self
  FROM (SELECT name, unnest({o.spellings('name')}) AS alias, unnest(range(6)) AS pos FROM (SELECT DISTINCT name FROM raw_requirements)) q
  LEFT JOIN (SELECT alias, canonical IS NULL AS self FROM aliases) h ON h.alias = q.alias GROUP BY q.name)"""


@query(
    "A16_coverage_by_category",
    o.sql(f"""
      SELECT category, count(*) AS cases, count(*) FILTER (found) AS found, round(100 * count(*) FILTER (found) / count(*), 6) AS percent
      FROM {_CASES} c JOIN {_RESOLVED_RAW} f ON f.name = c.name GROUP BY category"""),
)
def _(t: Tables) -> DataFrame:
    from talentloom.operators.metrics import coverage

    return coverage(_found(t), "category", F.col("found"))


@query(
    "A16_coverage_by_kind",
    o.sql(f"""
      SELECT CASE WHEN NOT found THEN 'not_found' WHEN self THEN 'self_canonical' ELSE 'synonym' END AS kind, count(*) AS cases
      FROM {_CASES} c JOIN {_RESOLVED_RAW} f ON f.name = c.name GROUP BY 1"""),
)
def _(t: Tables) -> DataFrame:
    return _found(t).groupBy("kind").agg(F.count("*").alias("cases"))


@query(
    "A17_grouped_coverage",
    o.sql(f"""
      SELECT CASE WHEN category IN ('ECONOMY', 'SMALL') THEN 'cloud SKU' ELSE 'general' END AS kind, count(*) AS cases,
        count(*) FILTER (found) AS found, round(100 * count(*) FILTER (found) / count(*), 6) AS percent
      FROM {_CASES} c JOIN {_RESOLVED_RAW} f ON f.name = c.name GROUP BY 1"""),
)
def _(t: Tables) -> DataFrame:
    from talentloom.operators.metrics import coverage

    grouped = F.when(F.col("category").isin("ECONOMY", "SMALL"), "cloud SKU").otherwise("general")
    return coverage(_found(t).withColumn("kind", grouped), "kind", F.col("found"))


_VARIANTS = """unnest([replace(name, ' ', '-'), replace(name, '.', ''), replace(name, '-', ' '), upper(name), lower(name),
          list_reduce(list_prepend('', list_transform(regexp_extract_all(name, '\\p{L}+|\\P{L}+'), lambda w: upper(w[1]) || lower(w[2:]))), lambda x, y: x || y),
          translate(name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'),
          upper(replace(name, ' ', '-')), lower(replace(name, ' ', '-')), replace(name, ' ', '_')])"""


@query(
    "A27_format_variants",
    o.sql(f"""
      WITH base AS (SELECT DISTINCT name FROM raw_requirements), made AS (SELECT DISTINCT {_VARIANTS} AS name FROM base)
      SELECT name, 'written' AS origin, NULL AS fill_order FROM base
      UNION ALL
      SELECT name, 'variant', sha256('42' || chr(1) || name) FROM made WHERE name <> '' AND name NOT IN (SELECT name FROM base)"""),
)
def _(t: Tables) -> DataFrame:
    """Written names and all their rewrites; a corpus is filled up in the order of the hash."""
    return variants.all_variants(t.raw_requirements.select("name").distinct(), "name").select("name", "origin", "fill_order")


@query(
    "A27_filled_pairs",
    o.sql(f"""
      WITH base AS (SELECT dst AS parent, src AS name FROM edges), size AS (SELECT count(*) * 3 AS target FROM base),
      made AS (SELECT name, min(parent) AS parent FROM (SELECT {_VARIANTS} AS name, parent FROM base)
        WHERE name <> '' AND name NOT IN (SELECT name FROM base) GROUP BY name)
      SELECT name AS child, parent, 'written' AS origin FROM base
      UNION ALL
      SELECT name, parent, 'variant' FROM (SELECT *, row_number() OVER (ORDER BY sha256('43' || chr(1) || name), name) AS place FROM made)
        WHERE place <= (SELECT target FROM size) - (SELECT count(*) FROM base)"""),
)
def _(t: Tables) -> DataFrame:
    """Given edges filled up to three times their number with rewrites of the child; the parent stays."""
    pairs = t.edges.select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return variants.filled(pairs, "child", 3 * pairs.count(), seed=43).select("child", "parent", "origin")
