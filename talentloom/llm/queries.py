"""One query per operator, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentloom.llm import chat, lbl, line_dedup, merkle, mih, mixing, near_dedup, packing, pii, prefix_trie, quality, toxicity, warc
from talentloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read_records(warc.write_archive(table(spark, folder, "pages")).index)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"))


def op4_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return mih.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(table(spark, folder, "conversations"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lbl.score_texts(table(spark, folder, "documents"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mixing.mix(table(spark, folder, "documents"), entropy_share=0.95)
    return chosen.select("doc_id", "source", "copy", "n_tokens", "block")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_removed", "text")


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    nodes = prefix_trie.trie(table(spark, folder, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_pii": op6_pii,
    "op8_lm_scoring": op8_lm_scoring,
    "op7_mixing": op7_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_toxicity": op13_toxicity,
}

OP2 = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_page THEN first_page END AS refers_to
FROM ranked
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), m AS (
  SELECT doc_id, t, len(lines) AS n_lines, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters
  FROM d
), w AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS three
  FROM d WHERE len(ws) > 2
), twice AS (
  SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), b AS (
  SELECT m.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN r ON r.doc_id = m.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 2 * n_dup_lines > n_lines
    OR 5 * n_upper > 2 * greatest(n_letters, 1) OR 10 * n_letters < 3 * length(t)) AS kept
FROM b
"""

OP7 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents
), s AS (
  SELECT source, sum(n)::BIGINT AS tokens FROM t GROUP BY source
), g AS (
  SELECT sum(tokens)::BIGINT AS budget, max(tokens) AS top, 0.95 * ln(count(*)) AS target,
    list(ln(tokens) - ln((SELECT max(tokens) FROM s))) AS logs FROM s
), bisect(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 16.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN above THEN middle ELSE low END, CASE WHEN above THEN high ELSE middle END FROM (
    SELECT i, low, high, middle, ln(z) - list_sum(list_transform(logs, lambda x: exp(middle * x) * middle * x)) / z >= target AS above FROM (
      SELECT i, low, high, (low + high) / 2 AS middle, logs, target, list_sum(list_transform(logs, lambda x: exp((low + high) / 2 * x))) AS z
      FROM bisect, g WHERE i < 36))
), e AS (
  SELECT round((low + high) / 2, 6) AS exponent FROM bisect WHERE i = 36
), p AS (
  SELECT source, tokens, greatest(round(scaled * budget / sum(scaled) OVER ())::BIGINT, 1) AS part, greatest(1, ceil(budget / 1048576))::BIGINT AS blocks
  FROM (SELECT source, tokens, budget, exp(exponent * (ln(tokens) - ln(top))) AS scaled FROM s, g, e)
), c AS (
  SELECT t.doc_id, t.source, t.n, p.tokens, p.part, p.blocks, unnest(range(0, (p.part - 1) // p.tokens + 1)) AS copy
  FROM t JOIN p ON p.source IS NOT DISTINCT FROM t.source
), laid AS (
  SELECT *, copy * tokens + coalesce(sum(n) OVER (PARTITION BY source, copy ORDER BY md5('1:' || copy || ':' || doc_id), n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM c
)
SELECT doc_id, source, copy::INTEGER AS copy, n AS n_tokens, floor(place / ceil(part / blocks))::BIGINT AS block FROM laid WHERE place + n <= part
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS shingle FROM d
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""

# The unsigned CRC-32 of a decimal number, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
    lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END)))"""


OP11 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, {CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), heads AS (
  SELECT c.conv_id, p AS d, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND p <= h
), seq AS (
  SELECT * FROM heads UNION ALL
  SELECT t.conv_id, p - h + (SELECT count(*) FROM heads x WHERE x.conv_id = t.conv_id), role, text FROM t JOIN c ON c.conv_id = t.conv_id AND p > h
), whole AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY d) FILTER (d IS NOT NULL), []) AS turns
  FROM c LEFT JOIN seq ON seq.conv_id = c.conv_id GROUP BY c.conv_id
), members AS (
  SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, unnest(list_transform(range(0, len(turns) + 1), lambda d: turns[1 : d])) AS prefix, len(turns) AS n
  FROM whole
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(strlen(any_value(prefix[depth].text)), 0) AS saved
  FROM members GROUP BY depth, prefix
), kids AS (
  SELECT u.*, count(v.depth) AS n_children FROM nodes u LEFT JOIN nodes v ON v.depth = u.depth + 1 AND v.prefix[1 : u.depth] = u.prefix GROUP BY ALL
), sums AS (
  SELECT u.depth, u.prefix, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
  FROM nodes u JOIN kids v ON v.depth >= u.depth AND v.prefix[1 : u.depth] = u.prefix GROUP BY ALL
)
SELECT k.conv_id, k.depth, up.conv_id AS parent_conv_id, k.n_convs, n_children, n_leaves, saved_tokens, k.ends_sha256
FROM kids k JOIN sums s ON s.depth = k.depth AND s.prefix = k.prefix LEFT JOIN nodes up ON up.depth = k.depth - 1 AND k.prefix[1 : k.depth - 1] = up.prefix
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {CRC32.format("doc_id")} % 3 = 0
    THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place
  FROM documents
), lower_levels(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM d GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], '')))
  FROM lower_levels WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM lower_levels WHERE len(nodes) = 1
), upper_levels(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], '')))
  FROM upper_levels WHERE len(nodes) > 1
), steps AS (
  SELECT doc_id, level, nodes, place // (8 ** level)::BIGINT AS q
  FROM d JOIN lower_levels l ON l.lang IS NOT DISTINCT FROM d.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1000 + level, nodes, s.place // (8 ** level)::BIGINT
  FROM d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang, upper_levels WHERE len(nodes) > 1
), sides AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step,
    array_to_string(nodes[8 * (q // 8) + 1 : q], '') AS l, array_to_string(nodes[q + 2 : 8 * (q // 8) + 8], '') AS r FROM steps
), proof AS (
  SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS p FROM sides GROUP BY doc_id
), fold(doc_id, step, node) AS (
  SELECT doc_id, 0, coalesce(tampered, leaf) FROM d
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(l || node || r) FROM fold f JOIN sides s ON s.doc_id = f.doc_id AND s.step = f.step + 1
), ends AS (
  SELECT doc_id, arg_max(node, step) AS folded_root FROM fold GROUP BY doc_id
)
SELECT d.doc_id, leaf, subroot, u.nodes[1] AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = u.nodes[1] AS verified
FROM d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang JOIN ends ON ends.doc_id = d.doc_id LEFT JOIN proof ON proof.doc_id = d.doc_id,
  upper_levels u WHERE len(u.nodes) = 1
"""

SQL: dict[str, str] = {
    "op2_warc": OP2,
    "op3_quality_rules": OP3,
    "op7_mixing": OP7,
    "op10_minhash_near_dedup": OP10,
    "op11_prefix_trie": OP11,
    "op12_merkle_manifest": OP12,
}
