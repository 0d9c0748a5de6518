"""Quality rules and line dedup against direct readings of their definitions."""

import re
from collections import Counter

from talentloom.llm import line_dedup, quality
from tests.llm.cases import documents, edited, empty, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    inside = {j for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_report_equals_definitions(spark):
    rows = texts()
    got = quality.report(documents(spark, rows), sample_rows=10).collect()
    assert len(got) == len(rows)
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == Counter((i, *base_measures(t)) for i, t in rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[1] and kept[30] and kept[60]
    assert not any(kept[i] for i in (50, 51, 52, 53, 61, 62, 63, 64))


def test_cascade_order_does_not_change_the_verdict():
    for _, text in texts():
        verdicts = {quality.first_rejection(quality.Text(text), order) is None for order in (quality.RULES, quality.RULES[::-1])}
        assert len(verdicts) == 1


def test_rules_are_ordered_by_rejection_per_cost():
    measured = {r.name: (1.0, 0.0) for r in quality.RULES} | {"symbols": (2.0, 0.9), "shouting": (1.0, 0.9), "few_words": (1.0, 0.1)}
    assert [r.name for r in quality.order_rules(quality.RULES, measured)][:3] == ["shouting", "symbols", "few_words"]


def test_cascade_keeps_all_columns_and_empty_tables(spark):
    docs = documents(spark)
    kept = quality.cascade(docs, kept_only=True)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()
    assert {r.rejected_by for r in quality.cascade(docs).where("doc_id = 51").collect()} == {"few_words"}
    assert quality.cascade(empty(spark), kept_only=True).count() == 0 and quality.report(empty(spark)).count() == 0


def shingles(line, k=line_dedup.SHINGLE):
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def brute_lines(rows):
    """Kept lines per distinct (doc_id, text): exact and near copies of earlier lines go."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    lines = sorted({line for *_, t in docs for line in t.split("\n") if line.strip(" \t\n\x0b\x0c\r")})
    parent = {line: line for line in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {line: shingles(line) for line in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            both = len(sets[a] & sets[b])
            if both * 100 >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    seen, out = set(), {}
    for has, i, t in docs:
        keep = []
        for line in t.split("\n"):
            if line not in parent or root(line) not in seen:
                keep.append(line)
                if line in parent:
                    seen.add(root(line))
        out[(i if has else None, t)] = "\n".join(keep)
    return out


def test_lines_against_brute_force(spark):
    base = "\n".join(prose(100 + i, 24).replace("\n", " ") for i in range(6))
    near = "\n".join(line.replace(" ", "  ", 1) for line in base.split("\n"))
    rows = [(1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (6, " \n\n \t"), (7, "ab\nab\ncd"), (8, edited(base, 3, 30)), (None, base), (9, prose(5, 400))]
    docs = documents(spark, rows)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    want = brute_lines(rows)
    texts_of = [(r.doc_id, r.text, r.n_removed) for r in got.collect()]
    assert len(texts_of) == len(rows)
    assert Counter((i, t) for i, t, _ in texts_of) == Counter((i, None if t is None else want[(i, t)]) for i, t in rows)
    assert next(n for i, _, n in texts_of if i == 2) >= 5
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_that_repeat_themselves_meet(spark):
    say = "this sentence says the same words over and over "
    pairs = [("-" * 500, "-" * 1000), ("|---" * 70 + "|", "|---" * 300 + "|"), (say * 5, say * 10), ("another chorus sung again, " * 4 + "end", "another chorus sung again, " * 30 + "end")]
    rows = [(2 * i + j, line) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    want = brute_lines(rows)
    assert got == {i: want[(i, line)] for i, line in rows}
    assert all(got[2 * i] == pair[0] and got[2 * i + 1] == "" for i, pair in enumerate(pairs))


def test_similar_lines_compares_sets_in_the_row_of_the_pair(spark):
    texts = ["", "short", "a" * 12, "a" * 40, "the quick brown fox jumps over", "the quick brown fox jumps over x", "é😀" * 9 + "the tail", "é😀" * 9 + "the tails"]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    met = line_dedup.similar_lines(spark.createDataFrame(pairs, "a long, b long"), lines)

    def shingles(text):
        units = text.encode("utf-16-be")
        return {units[i : i + 24] for i in range(0, len(units) - 23, 2)}

    sets = [shingles(text) for text in texts]
    expected = {(a, b) for a, b in pairs if sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {tuple(row) for row in met.collect()} == expected and {(2, 3), (4, 5), (6, 7)} <= expected
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_lines_of_repeated_rows_are_still_compared(spark):
    base = [prose(200 + i, 30).replace("\n", " ") for i in range(4)]
    rows = [(1, base[0]), (1, base[0]), (2, base[0] + " more"), (2, base[0] + " more"), (3, base[1]), (4, base[1] + " x"), (4, base[1] + " x"), (5, base[2]), (5, base[2]), (6, base[2][4:]), (7, base[3])]
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {(1, base[0], 0), (2, "", 1), (3, base[1], 0), (4, "", 1), (5, base[2], 0), (6, "", 1), (7, base[3], 0)}
