"""The trie against rebuilt conversations held in full, and the laws of the fingerprints."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from talentloom.llm import prefix_trie


def expected(rows):
    stored = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            stored[conv].append((turn is not None, turn or 0, role, order, text))
    stored = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in stored.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(stored):
        h = zlib.crc32(str(c).encode()) % 9
        turns = stored.get(c - c % 5, [])[:h] + stored[c][h:]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, own + sum(sums[k][1] for k in kids[p]))
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(kids[p]), *sums[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in nodes.items()
    )


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, print string, depth int")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    got = prefix_trie.trie(df).collect()
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in got) == expected(rows)
    return got


def test_shared_beginnings_copies_and_awkward_rows(spark):
    source, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(source.randrange(1, 14)):
            rows.append((conv, turn, source.choice(["user", "assistant"]), source.choice(["hi", "é", "no", ""])))
    rows += [(70, t, "user", f"same {t}") for t in range(12)] + [(c, t, "user", f"same {t}") for c in (71, 75, 76, 80) for t in range(12)]
    rows += [(90, None, None, None), (90, None, None, None), (90, 1, "b", "x"), (90, 1, "a", "y"), (90, 1, "a", "z"), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(103, 0, "user", "one turn, and its base has none"), (10**12 + 1, 5, "system", "long " * 40_000)]
    got = check(spark, rows)
    texts = {}
    for conv in {r[0] for r in rows if r[0] is not None}:  # references lead to the stored turn
        for place, r in enumerate(sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)), 1):
            texts[conv, place] = r[3] or ""
    assert all((r.ref_conv, r.ref_place) in texts for r in got if r.depth and r.ref_conv != 90)


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(9000)] + [(8, t, "user", f"t{t}") for t in range(5000)]
    rows += [(c, t, "user", "short") for c in range(20, 45) for t in range(2)]
    found = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    # Both rebuild from a base without turns, so they differ from their first turn on.
    lengths = {c: max(r.depth for r in found if r.conv_id == c) for c in (7, 8)}
    assert lengths == {c: n - zlib.crc32(str(c).encode()) % 9 for c, n in ((7, 9000), (8, 5000))}
    root = next(r for r in found if r.depth == 0)
    assert root.n_convs == 27 and root.conv_id == 7 and root.n_leaves == sum(r.n_children == 0 for r in found)
    one = [(c, t, "user", f"t{t}") for c in (10, 11) for t in range(3000)]
    check_chain = {(r.depth, r.n_convs) for r in prefix_trie.trie(spark.createDataFrame(one, "conv_id long, turn long, role string, text string")).collect()}
    assert check_chain == {(d, 2) for d in range(3001)}
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("seed", (0, 5))
def test_fingerprints_form_a_monoid(seed):
    prints, source = prefix_trie.Fingerprints(seed), random.Random(seed)
    turns = [source.randbytes(32) for _ in range(9)]
    for cut in range(10):
        head, tail = prints.product(turns[:cut]), prints.product(turns[cut:])
        assert prints.join(head, tail) == prints.product(turns)
        assert prints.without(prints.product(turns), head, cut) == tail
        assert prefix_trie.read(prefix_trie.written(head)) == head
    assert prints.product(turns[::-1]) != prints.product(turns)


def test_equal_fingerprints_of_different_prefixes_are_found_out(spark, monkeypatch):
    """With a multiplier of 1 order is lost, so prefixes clash; the next one is taken."""
    fair = prefix_trie.Fingerprints.__init__

    def weak(self, seed=0):
        fair(self, seed)
        if seed == 0:
            self.multiplier = self.inverse = 1

    monkeypatch.setattr(prefix_trie.Fingerprints, "__init__", weak)
    rows = [(c, t, "user", text) for c, order in ((100, "ab"), (200, "ba"), (300, "abc")) for t, text in enumerate([*order] * 6)]
    check(spark, rows)
