"""The domain views once more as plain SQL, for checking results in another engine.

`sql(body)` prefixes a query with the views it names, directly or through others.
"""

from __future__ import annotations

import re

from talentloom.constants import (
    CEFR_RANKS,
    CITY_KEYWORDS,
    DEGREE_KEYWORDS,
    DEGREE_RANKS,
    GENERIC_SKILLS,
    PRESENT_TOKENS,
    PROFICIENCY_PATTERNS,
    WHITESPACE,
)
from talentloom.functions.months import month_number
from talentloom.sources.tables import AS_OF

NOW = month_number(AS_OF)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(quote(v) for v in values)


SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def pick(index: str, *values: str | None) -> str:
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def pick_text(index: str, *values: str | None) -> str:
    return pick(index, *[None if v is None else quote(v) for v in values])


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def month(x: str) -> str:
    t = f"lower({strip(x)})"
    y = f"TRY_CAST(nullif(regexp_extract({t}, '^([0-9]{{4}})(?:[-/.]([0-9]{{1,2}}))?', 1), '') AS INTEGER)"
    m = f"TRY_CAST(nullif(regexp_extract({t}, '^([0-9]{{4}})(?:[-/.]([0-9]{{1,2}}))?', 2), '') AS INTEGER)"
    return (
        f"CASE WHEN {t} IN ({in_list(PRESENT_TOKENS)}) THEN {NOW} "
        f"WHEN {y} > 0 THEN {y} * 12 + least(greatest(coalesce({m}, 1), 1), 12) - 1 END"
    )


def degree(x: str) -> str:
    t = strip(f"lower({x})")
    chain = " ".join(f"WHEN {has_any(t, words)} THEN {quote(name)}" for name, words in DEGREE_KEYWORDS)
    return (
        f"CASE WHEN {x} = '' THEN NULL WHEN {t} IN ({in_list(DEGREE_RANKS)}) THEN {t} {chain} "
        f"WHEN {x} IS NOT NULL THEN 'other' END"
    )


def rank(x: str) -> str:
    return f"coalesce(CASE {x} " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in DEGREE_RANKS.items()) + " END, 0)"


def job_degree(x: str) -> str:
    return f"CASE WHEN {strip(f'lower({x})')} NOT IN ('', 'null', 'none', 'n/a', 'na') THEN {x} END"


def city(x: str) -> str:
    t = strip(f"lower({x})")
    chain = " ".join(f"WHEN {has_any(t, words)} THEN {quote(name)}" for name, words in CITY_KEYWORDS)
    return f"CASE WHEN {t} = 'hn' THEN 'Ha Noi' {chain} END"


def work_mode(x: str) -> str:
    t = strip(f"lower({x})")
    return f"CASE WHEN {t} IN ('onsite', 'hybrid', 'remote') THEN {t} ELSE 'onsite' END"


def min_years(x: str) -> str:
    number = f"CASE WHEN regexp_full_match({strip(x)}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({strip(x)} AS DOUBLE) END"
    return f"CAST(ceil(least(greatest(coalesce({number}, 0), 0), 2147483647)) AS INTEGER)"


def skill_key(x: str) -> str:
    inner = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return strip(f"regexp_replace({inner}, '\\s+', ' ', 'g')")


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


def half_even(x: str, digits: int) -> str:
    return f"CAST({fixed(x, digits)} AS DOUBLE)"


def title_case(x: str) -> str:
    words = [f"split_part({x}, ' ', {i})" for i in (1, 2)]
    return " || ' ' || ".join(f"upper(left({w}, 1)) || substr({w}, 2)" for w in words)


def framework(t: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_extract(lower({t}), {quote(p)}, 1) <> '' THEN {quote(f)}" for f, p in PROFICIENCY_PATTERNS
    ) + " END"


def level(t: str) -> str:
    branches = []
    for f, p in PROFICIENCY_PATTERNS:
        value = f"regexp_extract(lower({t}), {quote(p)}, 1)"
        if f == "jlpt":
            number = f"6 - TRY_CAST({value} AS DOUBLE)"
        elif f == "cefr":
            number = f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in CEFR_RANKS.items()) + " END"
        else:
            number = f"TRY_CAST({value} AS DOUBLE)"
        branches.append(f"WHEN {value} <> '' THEN CAST({number} AS DOUBLE)")
    return "CASE " + " ".join(branches) + " END"


def spellings(x: str) -> str:
    b = f"lower({strip(x)})"
    d = f"replace({b}, '.', '')"
    return (
        f"[{b}, replace({b}, ' ', '-'), replace({b}, ' ', ''), {d}, replace({d}, ' ', '-'), replace({d}, ' ', '')]"
    )


def month_name(i: str) -> str:
    return f"printf('%04d-%02d', CAST(floor(({i}) / 12) AS INTEGER), CAST(({i}) % 12 + 1 AS INTEGER))"


_DEGREES = ("", "High School", "Associate of Science", "BSc Physics", "M.Eng", "Doctorate", "Bootcamp", "master")
_START = "(year(o_orderdate) * 12 + month(o_orderdate) - 1)"
_N_PART = "(SELECT count(*) FROM part)"
_N_SUPPLIER = "(SELECT count(*) FROM supplier)"
_GENERIC = in_list(GENERIC_SKILLS)


def geocoded(view: str) -> str:
    segments = "list_filter(list_transform(string_split(address, ','), lambda s: trim(s)), lambda s: s <> '')"
    return f"""
      SELECT p.*, coalesce(f.lat, t.lat) AS lat, coalesce(f.lng, t.lng) AS lng
      FROM (SELECT *, CASE WHEN len({segments}) > 1 THEN {segments}[-1] END AS tail FROM {view}) p
      LEFT JOIN gazetteer f ON f.address = trim(p.address)
      LEFT JOIN gazetteer t ON t.address = p.tail"""


def blocks(pairs: str, own: str) -> str:
    """Ratcliff-Obershelp: repeatedly the longest common block, leftmost first."""
    return f"""
      SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS m FROM {pairs}
      UNION ALL
      SELECT a, b,
        CASE side WHEN 0 THEN alo ELSE -best.ni + best.k END, CASE side WHEN 0 THEN -best.ni ELSE ahi END,
        CASE side WHEN 0 THEN blo ELSE -best.nj + best.k END, CASE side WHEN 0 THEN -best.nj ELSE bhi END,
        CASE side WHEN 0 THEN best.k ELSE 0 END
      FROM (
        SELECT a, b, alo, ahi, blo, bhi, max({{'k': k, 'ni': -i, 'nj': -j}}) AS best
        FROM (SELECT *, unnest(range(1, least(ahi - i, bhi - j) + 1)) AS k FROM (
               SELECT *, unnest(range(blo, bhi)) AS j FROM (
                 SELECT *, unnest(range(alo, ahi)) AS i FROM {own} WHERE ahi > alo AND bhi > blo)))
        WHERE substr(a, i, k) = substr(b, j, k)
        GROUP BY a, b, alo, ahi, blo, bhi) g, (VALUES (0), (1)) s(side)"""


VIEWS: dict[str, str] = {
    "raw_candidates": f"""
      SELECT c_custkey AS cv_id, c_custkey % 50 <> 7 AS is_resume,
        CASE WHEN c_custkey % 40 = 0 THEN '' ELSE c_name END AS name,
        CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Works in ' || c_mktsegment END AS summary,
        {pick_text('c_custkey % 8', *_DEGREES)} AS degree_text,
        {pick_text('c_nationkey % 8', *_DEGREES)} AS second_degree_text,
        {pick_text('c_nationkey % 4', 'Hanoi', 'TP. HCM', 'Da Nang City', 'Hue')} AS city_text,
        CASE WHEN c_custkey % 3 <> 0 THEN 'Street ' || c_nationkey END AS raw_address,
        CASE c_custkey % 11 WHEN 0 THEN true WHEN 1 THEN false END AS willing_to_relocate,
        CASE c_custkey % 3 WHEN 0 THEN 'Japanese - JLPT N' || (c_custkey % 5 + 1)
          WHEN 1 THEN 'English: TOEIC ' || (c_custkey % 500 + 400)
          ELSE 'French (B' || (c_custkey % 2 + 1) || ')' END AS language
      FROM customer""",
    "placed_candidates": f"""
      SELECT cv_id, is_resume, name, willing_to_relocate, raw_address,
        greatest({rank(f"({degree('degree_text')})")}, {rank(f"({degree('second_degree_text')})")}) AS degree_rank,
        {city('city_text')} AS city,
        CASE WHEN raw_address IS NOT NULL THEN concat_ws(', ', raw_address, {city('city_text')}) END AS address
      FROM raw_candidates""",
    "gazetteer": f"""
      SELECT 'Street ' || n_nationkey || ', ' ||
          coalesce({pick_text('n_nationkey % 4', 'Ha Noi', 'Ho Chi Minh', 'Da Nang')}, 'Ha Noi') AS address,
        CAST(n_nationkey * 0.5 + 10 AS DOUBLE) AS lat, CAST(n_nationkey * 0.25 + 100 AS DOUBLE) AS lng
      FROM nation WHERE n_nationkey % 5 <> 0
      UNION ALL
      SELECT {pick_text('n_nationkey', 'Ha Noi', 'Ho Chi Minh', 'Da Nang')},
        CAST(n_nationkey * 0.5 + 10 AS DOUBLE), CAST(n_nationkey * 0.25 + 100 AS DOUBLE)
      FROM nation WHERE n_nationkey < 3""",
    "candidates": geocoded("placed_candidates"),
    "cv_skills": f"""
      SELECT cv_id, pos, CASE WHEN pos = 5 THEN p_brand WHEN pos % 2 = 0 THEN {title_case('p_name')} ELSE p_name END AS skill
      FROM (SELECT c_custkey AS cv_id, unnest(range(10)) AS pos FROM customer)
      JOIN part ON p_partkey = (cv_id * 7 + pos * 13) % {_N_PART}""",
    "credentials": "SELECT cv_id, language AS text FROM raw_candidates",
    "raw_employment": f"""
      SELECT o_custkey AS cv_id, o_orderkey AS job_id,
        CASE WHEN o_orderkey % 97 = 0 THEN ''
          WHEN o_orderpriority = '1-URGENT' THEN replace({month_name(_START)}, '-', '/')
          WHEN o_orderpriority = '2-HIGH' THEN ' ' || {month_name(_START)}
          ELSE {month_name(_START)} END AS start_text,
        CASE WHEN o_orderstatus = 'P' THEN 'Present' WHEN o_orderkey % 89 = 0 THEN ''
          ELSE {month_name(_START + ' + 1 + o_orderkey % 36')} END AS end_text
      FROM orders""",
    "employment": f"""
      SELECT cv_id, job_id, s AS start_m, greatest(e, s) AS end_m FROM (
        SELECT cv_id, job_id, {month('start_text')} AS s, coalesce({month('end_text')}, {NOW}) AS e
        FROM raw_employment)""",
    "stacks": """
      SELECT DISTINCT o_custkey AS cv_id, o_orderkey AS job_id, p_name AS skill
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "raw_jobs": f"""
      SELECT s_suppkey AS jd_id, s_name AS title,
        CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Serve nation ' || s_nationkey END AS responsibilities,
        {pick_text('s_suppkey % 7', '', '1', '1.5', '3', 'abc', '4.2', '6')} AS min_years_text,
        {pick_text('s_suppkey % 8', None, 'none', 'bachelor', 'master', 'phd', 'associate', 'high_school', 'n/a')} AS education_text,
        {pick_text('s_suppkey % 4', 'Onsite ', 'HYBRID', 'remote', 'oversea')} AS work_mode_text,
        {pick_text('s_nationkey % 4', 'ha noi', 'Saigon', 'danang', 'Unknown')} AS city_text,
        CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE 'Street ' || s_nationkey END AS raw_address
      FROM supplier""",
    "placed_jobs": f"""
      SELECT jd_id, title, responsibilities, raw_address, {min_years('min_years_text')} AS min_years,
        {job_degree('education_text')} AS degree, {rank(f"({job_degree('education_text')})")} AS degree_rank,
        {work_mode('work_mode_text')} AS work_mode, coalesce({city('city_text')}, 'Ha Noi') AS city,
        CASE WHEN raw_address <> '' THEN raw_address || ', ' || coalesce({city('city_text')}, 'Ha Noi')
          ELSE coalesce({city('city_text')}, 'Ha Noi') END AS address
      FROM raw_jobs""",
    "jobs": geocoded("placed_jobs"),
    "raw_requirements": f"""
      SELECT jd_id, CASE WHEN pos < 12 THEN 'required' WHEN pos < 16 THEN 'preferred' ELSE 'nice_to_have' END AS tier,
        CASE WHEN pos < 12 THEN pos // 2 ELSE pos + 100 END AS req_pos,
        CASE WHEN pos < 12 THEN pos % 2 ELSE 0 END AS alt_pos, name,
        CASE WHEN pos < 12 THEN p_size % 3 + 1 WHEN pos < 16 THEN 2 ELSE 1 END AS weight
      FROM (
        SELECT p_partkey % {_N_SUPPLIER} AS jd_id, p_partkey // {_N_SUPPLIER} AS pos, p_size,
          CASE WHEN p_size % 10 <= 2 THEN {title_case('p_name')}
            WHEN p_size % 10 = 3 THEN upper(replace(p_name, ' ', '-'))
            WHEN p_size % 10 = 4 THEN p_name || 's'
            WHEN p_size % 10 = 5 THEN replace(p_name, ' ', '')
            WHEN p_size % 10 = 6 THEN 'JLPT N' || (p_partkey % 5 + 1)
            WHEN p_size % 10 = 7 THEN 'TOEIC ' || (p_size * 8 + 400)
            WHEN p_size % 10 = 8 AND p_partkey % 2 = 0 THEN 'Problem-Solving'
            ELSE p_name END AS name
        FROM part)""",
    "requirements": f"""
      SELECT r.* FROM raw_requirements r WHERE NOT EXISTS (
        SELECT 1 FROM raw_requirements g WHERE g.jd_id = r.jd_id AND g.req_pos = r.req_pos
          AND g.alt_pos = 0 AND {skill_key('g.name')} IN ({_GENERIC}))""",
    "groups": """
      SELECT jd_id, tier, req_pos, arg_min(weight, alt_pos) AS weight,
        string_agg(name, ' / ' ORDER BY first_pos) AS label
      FROM (SELECT *, alt_pos AS first_pos FROM requirements
            QUALIFY row_number() OVER (PARTITION BY jd_id, req_pos, name ORDER BY alt_pos) = 1)
      GROUP BY jd_id, tier, req_pos""",
    "applications": """
      SELECT DISTINCT o_custkey AS cv_id, l_suppkey AS jd_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "tags": """
      SELECT DISTINCT replace(p_name, ' ', '-') AS name, starts_with(p_name, 'new') AS has_synonyms,
        p_name LIKE '% ring' AS in_collective
      FROM part""",
    "synonyms": """
      SELECT DISTINCT 1 AS seq, replace(p_name, ' ', '-') AS from_tag, 'new-' || replace(p_name[5:], ' ', '-') AS to_tag
      FROM part WHERE p_name LIKE 'old %' AND p_name NOT LIKE '% ring'
      UNION
      SELECT 2, replace(p_name, ' ', ''), replace(p_name, ' ', '-')
      FROM part WHERE p_name NOT LIKE 'old %' AND p_name NOT LIKE '% ring'""",
    "aliases": """
      SELECT coalesce(t.name, s.from_tag) AS alias,
        coalesce(s.to_tag, CASE WHEN t.has_synonyms THEN t.name END) AS canonical
      FROM (SELECT * FROM tags WHERE NOT in_collective) t
      FULL JOIN (SELECT from_tag, arg_max(to_tag, seq) AS to_tag FROM synonyms GROUP BY 1) s ON s.from_tag = t.name""",
    "edges": """
      SELECT DISTINCT replace(p_name, ' ', '-') AS src, parent || '-' || split_part(p_name, ' ', 2) AS dst
      FROM (SELECT p_name, CASE split_part(p_name, ' ', 1) WHEN 'new' THEN 'red' WHEN 'red' THEN 'hot'
              WHEN 'hot' THEN 'cold' WHEN 'large' THEN 'small' END AS parent FROM part)
      WHERE parent IS NOT NULL AND p_name NOT LIKE '% ring'""",
    "implies": """
      SELECT src, dst FROM edges
      UNION
      SELECT i.src, e.dst FROM implies i JOIN edges e ON i.dst = e.src WHERE i.src <> e.dst""",
    "routes": """
      SELECT CAST(a * 0.5 + 10 AS DOUBLE) AS lat1, CAST(a * 0.25 + 100 AS DOUBLE) AS lng1,
        CAST(b * 0.5 + 10 AS DOUBLE) AS lat2, CAST(b * 0.25 + 100 AS DOUBLE) AS lng2, abs(a - b) * 7.0::DOUBLE + 3 AS duration_min
      FROM (SELECT n_nationkey AS a, unnest(range(25)) AS b FROM nation) WHERE (a + b) % 9 <> 4""",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "labelled_pairs": """
      SELECT a.cv_id, a.jd_id, c.label AS cv_label, j.label AS jd_label, c.label = j.label AS same,
        list_dot_product(c.v, j.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(j.v, j.v))) AS exact, round(exact, 6) AS cosine
      FROM applications a JOIN vectors c ON c.vec_id = a.cv_id JOIN vectors j ON j.vec_id = a.jd_id""",
    "tokens": f"""
      SELECT DISTINCT cv_id, token FROM (
        SELECT cv_id, lower(skill) AS token FROM cv_skills
        UNION ALL SELECT cv_id, lower(skill) FROM stacks
        UNION ALL SELECT cv_id, lower({strip('text')}) FROM credentials
        UNION ALL SELECT cv_id, {strip('part')} FROM (
          SELECT cv_id, unnest(regexp_split_to_array(lower(text), '[-–—:,/()]+')) AS part FROM credentials))
      WHERE token <> ''""",
    "spelled": f"""
      SELECT name, unnest({spellings('name')}) AS alias, unnest(range(6)) AS pos
      FROM (SELECT token AS name FROM tokens UNION SELECT name FROM requirements UNION SELECT skill FROM cv_skills)""",
    "resolved": f"""
      SELECT s.name, coalesce(arg_min(h.hit, s.pos), any_value(lower({strip('s.name')}))) AS canonical,
        count(h.hit) > 0 AS found, coalesce(arg_min(h.alias, s.pos) FILTER (h.hit IS NOT NULL), '') AS matched_key,
        CASE WHEN count(h.hit) = 0 THEN 'not_found'
          WHEN arg_min(h.self, s.pos) FILTER (h.hit IS NOT NULL) THEN 'self_canonical' ELSE 'synonym' END AS kind
      FROM spelled s LEFT JOIN (SELECT alias, coalesce(canonical, alias) AS hit, canonical IS NULL AS self FROM aliases) h
        ON h.alias = s.alias
      GROUP BY s.name""",
    "token_facts": f"""
      SELECT t.token, r.canonical, r.found, {framework('t.token')} AS framework, {level('t.token')} AS rank
      FROM (SELECT DISTINCT token FROM tokens) t JOIN resolved r ON r.name = t.token""",
    "name_facts": f"""
      SELECT q.name, lower({strip('q.name')}) AS n, r.canonical, {framework('q.name')} AS framework, {level('q.name')} AS rank
      FROM (SELECT DISTINCT name FROM requirements) q JOIN resolved r ON r.name = q.name""",
    "ro_pairs": """
      SELECT DISTINCT n AS a, token AS b FROM name_facts JOIN token_facts
        ON name_facts.framework IS NULL AND n <> token
        AND 2.0 * least(length(n), length(token)) / (length(n) + length(token)) >= 0.85""",
    "ro_blocks": blocks("ro_pairs", "ro_blocks"),
    "ro_ratio": """
      SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS ratio FROM ro_blocks GROUP BY a, b""",
    "unknown_pairs": """
      SELECT DISTINCT token AS a, word AS b FROM token_facts JOIN (
        SELECT alias AS word FROM aliases UNION SELECT canonical FROM aliases WHERE canonical IS NOT NULL)
        ON NOT found AND framework IS NULL
        AND 2.0 * least(length(word), length(token)) / (length(word) + length(token)) >= 0.85""",
    "unknown_blocks": blocks("unknown_pairs", "unknown_blocks"),
    "unknown_ratio": """
      SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS ratio FROM unknown_blocks GROUP BY a, b""",
    # Labelled spelling pairs: a name and its canonical (same), a skill and what it implies (not same).
    "case_pairs": """
      SELECT DISTINCT n AS a, canonical AS b, true AS same FROM name_facts WHERE framework IS NULL
        AND canonical <> n
      UNION SELECT src, dst, false FROM implies""",
    "case_blocks": blocks("case_pairs", "case_blocks"),
    "case_ratio": """
      SELECT a, b, same, 2.0::DOUBLE * m / (length(a) + length(b)) AS ratio
      FROM case_pairs JOIN (SELECT a, b, sum(m) AS m FROM case_blocks GROUP BY a, b) USING (a, b)""",
    "token_keys": """
      SELECT token, 't:' || token AS key, 0 AS layer, 0.0::DOUBLE AS rank FROM token_facts
      UNION ALL SELECT token, 'c:' || canonical, 1, 0.0::DOUBLE FROM token_facts
      UNION ALL SELECT token, 'c:' || dst, 2, 0.0::DOUBLE FROM token_facts JOIN implies ON src = canonical
      UNION ALL SELECT token, 'p:' || framework, 4, rank FROM token_facts WHERE framework IS NOT NULL""",
    "name_keys": """
      SELECT name, 't:' || n AS key, 0 AS asked_layer, 0.0::DOUBLE AS ratio, CAST(NULL AS DOUBLE) AS asked_rank FROM name_facts
      UNION ALL SELECT name, 'c:' || canonical, NULL, 0.0::DOUBLE, NULL FROM name_facts
      UNION ALL SELECT name, 'p:' || framework, 4, 0.0::DOUBLE, rank FROM name_facts WHERE framework IS NOT NULL
      UNION ALL SELECT name, 't:' || b, 3, ratio, NULL FROM name_facts JOIN ro_ratio ON a = n
        WHERE framework IS NULL AND ratio >= 0.85""",
    "hits": """
      SELECT k.token, a.name, coalesce(a.asked_layer, k.layer) AS layer,
        CASE coalesce(a.asked_layer, k.layer) WHEN 3 THEN -a.ratio WHEN 4 THEN -k.rank ELSE 0.0::DOUBLE END AS tie,
        CASE WHEN coalesce(a.asked_layer, k.layer) <> 4 OR k.rank >= a.asked_rank THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS credit
      FROM token_keys k JOIN name_keys a USING (key)""",
    "met": """
      SELECT cv_id, name, h.layer AS layer, h.via AS via, h.credit AS credit FROM (
        SELECT cv_id, name, min({'layer': layer, 'tie': tie, 'via': token, 'credit': credit}) AS h
        FROM tokens JOIN hits USING (token) GROUP BY cv_id, name)""",
    "evidence": """
      SELECT p.cv_id, p.jd_id, g.tier, g.req_pos, g.label, g.weight,
        CASE WHEN coalesce(m.h.credit, 0) = 0 THEN 'missing' WHEN m.h.layer = 2 THEN 'matched_implied' ELSE 'matched' END AS status,
        coalesce(['layer0', 'layer1', 'layer2', 'layer3', 'proficiency'][m.h.layer + 1], 'missing') AS matched_layer,
        coalesce(m.h.via, '') AS matched_via, CAST(coalesce(m.h.credit, 0) AS DOUBLE) AS credit
      FROM applications p JOIN groups g ON g.jd_id = p.jd_id
      LEFT JOIN (
        SELECT a.cv_id, a.jd_id, r.req_pos,
          min({'layer': layer, 'minus': -credit, 'alt': alt_pos, 'via': via, 'credit': credit}) AS h
        FROM applications a JOIN requirements r ON r.jd_id = a.jd_id JOIN met ON met.cv_id = a.cv_id AND met.name = r.name
        GROUP BY a.cv_id, a.jd_id, r.req_pos) m
      ON m.cv_id = p.cv_id AND m.jd_id = p.jd_id AND m.req_pos = g.req_pos""",
    # Months by listing them: independent of any interval arithmetic.
    "total_months": """
      SELECT cv_id, count(DISTINCT m) AS total_months FROM (
        SELECT cv_id, unnest(range(start_m, end_m)) AS m FROM employment WHERE start_m IS NOT NULL)
      GROUP BY cv_id""",
    "name_months": """
      SELECT DISTINCT s.cv_id, h.name, unnest(range(e.start_m, e.end_m)) AS m
      FROM stacks s JOIN hits h ON h.token = lower(s.skill) AND h.credit > 0
      JOIN employment e ON e.cv_id = s.cv_id AND e.job_id = s.job_id WHERE e.start_m IS NOT NULL""",
    "name_month_lists": "SELECT cv_id, name, list(m) AS ms FROM name_months GROUP BY cv_id, name",
    "group_months": """
      SELECT a.cv_id, a.jd_id, r.req_pos, len(list_distinct(flatten(list(ms)))) AS months
      FROM applications a JOIN requirements r ON r.jd_id = a.jd_id AND r.tier = 'required'
      JOIN name_month_lists n ON n.cv_id = a.cv_id AND n.name = r.name
      GROUP BY a.cv_id, a.jd_id, r.req_pos""",
    "semantic": """
      SELECT a.cv_id, a.jd_id, CASE WHEN l.exact IS NULL THEN 0.5::DOUBLE ELSE greatest(least(l.exact, 1.0), 0.0) END AS semantic
      FROM applications a LEFT JOIN labelled_pairs l ON l.cv_id = a.cv_id AND l.jd_id = a.jd_id""",
    "skills": """
      SELECT cv_id, jd_id, CASE WHEN sum(weight) > 0 THEN sum(weight * credit) / sum(weight) ELSE 1.0 END AS skills
      FROM evidence GROUP BY cv_id, jd_id""",
    "experience": """
      SELECT a.cv_id, a.jd_id, j.min_years,
        CASE WHEN j.min_years > 0 THEN least(coalesce(t.total_months, 0) / 12.0::DOUBLE / j.min_years, 1.0) END AS years_ratio,
        CASE WHEN j.min_years > 0 AND w.required_weight > 0 THEN coalesce(d.depth, 0) / (j.min_years * 12 * w.required_weight) END AS depth_ratio
      FROM applications a JOIN jobs j ON j.jd_id = a.jd_id
      LEFT JOIN total_months t ON t.cv_id = a.cv_id
      LEFT JOIN (SELECT jd_id, sum(weight) AS required_weight FROM groups WHERE tier = 'required' GROUP BY 1) w ON w.jd_id = a.jd_id
      LEFT JOIN (
        SELECT m.cv_id, m.jd_id, sum(g.weight * least(m.months, j2.min_years * 12)) AS depth
        FROM group_months m JOIN groups g ON g.jd_id = m.jd_id AND g.req_pos = m.req_pos
        JOIN jobs j2 ON j2.jd_id = m.jd_id WHERE j2.min_years > 0
        GROUP BY m.cv_id, m.jd_id) d ON d.cv_id = a.cv_id AND d.jd_id = a.jd_id""",
    "experience_scores": """
      SELECT cv_id, jd_id, CAST(CASE WHEN min_years = 0 THEN 1.0 WHEN depth_ratio IS NULL THEN years_ratio
        ELSE (depth_ratio + years_ratio) / 2 END AS DOUBLE) AS experience FROM experience""",
    "education": """
      SELECT a.cv_id, a.jd_id, CAST(CASE WHEN j.degree_rank = 0 THEN 1.0 WHEN c.degree_rank = 0 THEN 0.5
        ELSE least(c.degree_rank / j.degree_rank, 1.0) END AS DOUBLE) AS education
      FROM applications a JOIN candidates c ON c.cv_id = a.cv_id JOIN jobs j ON j.jd_id = a.jd_id""",
    "location": f"""
      SELECT a.cv_id, a.jd_id, CAST(CASE WHEN j.work_mode = 'remote' THEN 1.0 WHEN c.willing_to_relocate THEN 1.0
        WHEN c.raw_address IS NULL THEN (CASE WHEN c.city IS NULL THEN 0.5 WHEN c.city = j.city THEN 0.5 ELSE 0.0 END)
        WHEN c.lat IS NULL OR j.lat IS NULL OR r.duration_min IS NULL THEN 0.5
        ELSE {half_even("greatest(0.0, 1 - r.duration_min / (CASE WHEN j.work_mode = 'onsite' THEN 45.0 ELSE 75.0 END)::DOUBLE)", 3)}
        END AS DOUBLE) AS location
      FROM applications a JOIN candidates c ON c.cv_id = a.cv_id JOIN jobs j ON j.jd_id = a.jd_id
      LEFT JOIN routes r ON r.lat1 = c.lat AND r.lng1 = c.lng AND r.lat2 = j.lat AND r.lng2 = j.lng""",
    "dims": """
      SELECT a.cv_id, a.jd_id, s.semantic, coalesce(k.skills, 1.0) AS skills, x.experience, e.education, l.location
      FROM applications a JOIN semantic s USING (cv_id, jd_id) LEFT JOIN skills k USING (cv_id, jd_id)
      JOIN experience_scores x USING (cv_id, jd_id) JOIN education e USING (cv_id, jd_id) JOIN location l USING (cv_id, jd_id)""",
    "scores": f"""
      SELECT cv_id, jd_id,
        {half_even('100 * (0.0::DOUBLE + semantic * 0.3::DOUBLE + skills * 0.3::DOUBLE + experience * 0.25::DOUBLE + education * 0.1::DOUBLE + location * 0.05::DOUBLE)', 1)} AS final_score,
        {', '.join(f'{half_even(f"{d} * 100", 1)} AS {d}' for d in ('semantic', 'skills', 'experience', 'education', 'location'))}
      FROM dims""",
    "results": """
      SELECT user_id AS batch_id, event_id AS ord, 'https://cv.example.org/' || event_id || '.pdf' AS cv_url,
        CASE WHEN event_type = 'error' THEN 'No text could be extracted from file' END AS error,
        CASE WHEN event_type <> 'error' THEN least(value, 100.0::DOUBLE) END AS final_score,
        event_type <> 'error' AND event_id % 17 <> 0 AS has_record,
        CASE WHEN event_type <> 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0 THEN 64 END AS vector_size
      FROM events""",
    "batches": f"""
      SELECT user_id AS batch_id, 'batch ' || user_id AS name,
        CASE WHEN user_id % 7 <> 0 THEN user_id % {_N_SUPPLIER} END AS jd_id, min(ts) AS created_at
      FROM events GROUP BY user_id""",
}

_RECURSIVE = {"implies", "ro_blocks", "unknown_blocks", "case_blocks"}


def sql(body: str) -> str:
    """The query with every view it needs, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and name not in visiting and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visiting.add(name)
                need(VIEWS[name])
                order.append(name)

    visiting: set[str] = set()
    need(body)
    if not order:
        return body
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    # Small shared views are computed once; DuckDB inlines the rest as it likes.
    views = ",\n".join(
        f"{name} AS {'' if name in _RECURSIVE else 'MATERIALIZED '}({VIEWS[name]})" for name in order
    )
    return f"WITH RECURSIVE {views}\n{body}"
