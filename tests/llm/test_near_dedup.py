"""Near-duplicates and components against brute force."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from talentloom.llm import line_dedup, links, near_dedup
from tests.llm.cases import documents, edited, empty, prose, texts


def brute(rows):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[(i, t)] = frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    smallest = {}
    for i, t in sets:
        if i is not None:
            smallest[root((i, t))] = min(i, smallest.get(root((i, t)), i))
    return {(i, t): (len(s), smallest.get(root((i, t)), i)) for (i, t), s in sets.items()}


def test_groups_equal_brute_force(spark):
    rows = texts()
    want = brute(rows)
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    expected = sorted((str(i), *want[(i, t)], i == want[(i, t)][1] or not want[(i, t)][0]) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == [(a, n, c, k) for a, n, c, k in expected]


def test_large_group_with_members_out_of_reach(spark):
    base = prose(3, 150)
    rows = [(i, edited(base, i, 60 if i % 3 else 6)) for i in range(150)]
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: want[(i, t)][1] for i, t in rows}


def test_bound_drops_only_what_has_no_partner(spark):
    """The path for keys with many members finds the same links as comparing all."""
    source = random.Random(2)
    sets = {i: sorted(source.sample(range(40), 30)) for i in range(60)}
    frame = spark.createDataFrame([(i, len(s), s) for i, s in sets.items()], "id long, size int, items array<long>")
    # Keys 1 and 2 have the same members, key 3 half of them.
    keys = F.explode(F.when(F.col("id") < 30, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(F.lit(1), F.lit(2))))
    held = links.shared_postings(frame.select(keys.alias("key"), "id", F.lit(0).alias("rank")))
    bits = frame.select("id", F.explode("items").alias("item")).groupBy("id").agg(*links.bitmap(F.col("item")))
    outlines = frame.join(bits, "id").select("id", F.col("size").alias("low"), F.col("size").alias("high"), F.array(*[f"b{w}" for w in range(links.WORDS)]).alias("bits"))

    def item_rows(active):
        return frame.join(active, "id").select("id", "component", F.explode("items").alias("item"))

    for large in (2, 1000):
        found = links.linked_components(held, outlines, 75, lambda pairs: links.similar_pairs(pairs, frame, 75), item_rows, large)
        got = {r.node: r.component for r in found.collect()}
        parent = {i: i for i in sets}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in itertools.combinations(sets, 2):
            both = len(set(sets[a]) & set(sets[b]))
            if both * 100 >= 75 * (60 - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
        assert {i: got.get(i, i) for i in sets} == {i: root(i) for i in sets}


def test_outlines_never_exclude_a_link(spark):
    """Lines at and around the bound, lines that repeat themselves, and short ones."""
    source = random.Random(5)
    base = "".join(source.choice("abcdefgh ") for _ in range(300))
    lines = [base[:n] + "".join(source.choice("xyz") for _ in range(m)) for n in (40, 150, 260, 300) for m in (0, 5, 20, 60)]
    lines += ["same words again " * n for n in (2, 3, 9, 40)] + ["short", "", "exactly 12 c"]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    pairs = spark.createDataFrame(list(itertools.combinations(range(len(lines)), 2)), "a long, b long")
    outlines = line_dedup.outlines(frame)
    left = {(r.a, r.b) for r in links.possible_pairs(pairs, outlines, 75).collect()}
    found = {tuple(r) for r in line_dedup.similar_lines(pairs, frame).collect()}
    sets = [{line[k : k + 12] for k in range(len(line) - 11)} for line in lines]
    want = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if sets[a] | sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert found == want and want <= left and len(left) < pairs.count() / 2
    for r in outlines.collect():
        assert r.low <= len(sets[r.id]) <= r.high


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in links.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_table(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_pipeline_keeps_documents_without_an_id(spark):
    base, other, solo = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(7, base), (8, base), (None, base), (None, other), (None, other), (None, edited(other, 4, 150)), (None, solo), (None, ""), (9, ""), (-5, prose(4, 90)), (-5, prose(4, 90))]
    docs = documents(spark, rows)
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert [i for i, t in kept if t == base] == [7] and kept.count((None, solo)) == 1
    assert len([t for _, t in kept if t in (other, edited(other, 4, 150))]) == 1
    assert kept.count((None, "")) == kept.count((9, "")) == 1 and kept.count((-5, prose(4, 90))) == 2 and len(kept) == 7
    mixed = corpus_pipeline.mixing_stage(spark, got, "").select("text").distinct().count()
    assert mixed == len({t for _, t in kept})
    assert corpus_pipeline.near_stage(spark, empty(spark), "").count() == 0


def test_rarest_items_hold_the_rarest_common_item_of_every_link(spark):
    base = list(range(100))
    sets = [set(base[: 60 + k]) | {1000 * k + j for j in range(k % 4)} for k in range(12)]
    sets += [set(base[k : k + 40]) for k in range(0, 50, 7)]
    rows = spark.createDataFrame([(i, item) for i, items in enumerate(sets) for item in items], "id long, item long")
    shared = links.shared_items(rows)
    rare = links.rarest_items(shared, 75)
    one, other = rare.select("item", F.col("id").alias("a")), rare.select("item", F.col("id").alias("b"))
    met = {tuple(r) for r in one.join(other, "item").where("a < b").select("a", "b").distinct().collect()}
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert alike and alike <= met
    assert rare.count() * 2 < shared.count()


def test_outlines_tell_near_misses_apart(spark):
    """Pairs of long lines at a similarity of about 0.6 are left out by their outlines alone,
    though most bits of both are set."""
    source = random.Random(8)
    text = lambda n: "".join(source.choice("abcdefghijklmnop ") for _ in range(n))
    base = text(900)
    lines = [base[:k] + text(225) + base[k + 225 :] for k in range(0, 600, 60)]  # 675 characters of the base each
    frame = spark.createDataFrame(list(enumerate([base, *lines, base[:850]])), "id long, line string")
    pairs = spark.createDataFrame(list(itertools.combinations(range(len(lines) + 2), 2)), "a long, b long")
    outlines = line_dedup.outlines(frame)
    left = {(r.a, r.b) for r in links.possible_pairs(pairs, outlines, 75).collect()}
    assert left == {tuple(r) for r in line_dedup.similar_lines(pairs, frame).collect()} == {(0, 11)}
    sizes = {r.id: (r.low, r.high) for r in outlines.collect()}
    assert sizes == {i: (len({s[k : k + 12] for k in range(len(s) - 11)}),) * 2 for i, s in enumerate([base, *lines, base[:850]])}
