"""Neighbour search, personal data and language model: exactness, recall, gradients."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from talentloom.llm import lbl, mih, pii
from tests.llm.cases import documents, empty, prose, texts


def test_pigeonhole_retrieves_the_whole_radius():
    source = np.random.default_rng(1)
    codes = source.integers(0, 2**16, (500, 4)).astype(np.uint16)
    codes[:200] ^= (source.random((200, 4)) < 0.3).astype(np.uint16) * 5
    index = mih.Index(codes)
    for query in codes[::50]:
        apart = np.bitwise_count(codes ^ query).sum(axis=1)
        for radius in (0, 2, 9, 20, 33):
            allowed = mih.thresholds(radius, 4)
            assert (allowed + 1).sum() == radius + 1
            assert index.within(query, radius, allowed).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_neighbours_have_recall_and_exact_scores(spark):
    source = np.random.default_rng(2)
    x = source.normal(size=(1500, 16)) * source.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [math.nan] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0] * 3), (None, [1.0] * 16), (20, x[20].tolist())]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, v int")
    got = mih.neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=10, block_rows=400, query_rows=30).collect()
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:10]
        mine = [r for r in got if r.query_id == q and r.rank <= 10]
        hits += len({r.vec_id for r in mine} & set(best))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        assert [r.vec_id for r in sorted(mine, key=lambda r: r.rank)] == [r.vec_id for r in sorted(mine, key=lambda r: (-r.score, r.vec_id))]
    assert hits >= 0.9 * 75 * 10
    twice = [r.vec_id for r in got if r.query_id == 20]  # asked by two equal rows
    assert len(twice) == len(set(twice)) == 10
    few = vectors.where("vec_id < 5")
    assert mih.neighbours(few, few.where("vec_id = 0"), k=10).count() == 4
    assert mih.neighbours(few.limit(0), few.limit(0)).count() == 0


def test_every_query_ends_with_k_rows(spark):
    source = np.random.default_rng(6)
    dense = source.normal(size=16) + 0.01 * source.normal(size=(400, 16))
    x = np.concatenate([dense, 3 * source.normal(size=(6, 16)), -dense[:1]])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = mih.neighbours(vectors, vectors.where("vec_id % 50 = 0 OR vec_id >= 400"), block_rows=100).collect()
    assert Counter(r.query_id for r in got) == {q: 20 for q in [*range(0, 401, 50), *range(401, 407)]}
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got) and all(r.query_id != r.vec_id for r in got)
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 for r in got)
    ten = vectors.where("vec_id >= 397")
    counts = Counter(r.query_id for r in mih.neighbours(ten, ten).collect())
    assert counts == {q: 9 for q in range(397, 407)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_base_spans_equal_the_plain_patterns():
    source = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(source.choice(list("ab1.@-_+ (9)0,"), source.integers(1, 30)))
        assert [s[:2] for s in pii.emails(text)] == [m.span() for m in EMAIL.finditer(text)]
        good = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s[:2] for s in pii.base_spans(text) if s[2] == 1] == good
    text = "4111 1111 1111 1111, 4111111111111112, +1 (656) 555-6510 and 300.1.1.1"
    assert pii.written(pii.base_spans(text)) == "card:0:19,phone:39:56"


def test_crf_gradients_by_differences():
    source = np.random.default_rng(4)
    model = pii.Tagger.new(3, 1)
    x, y = source.integers(0, len(pii.CLASSES) + 1, (2, 6)), source.integers(0, pii.TAGS, (2, 6))
    _, found = model.gradients(x, y)
    for w, g in zip(model.weights(), found, strict=True):
        for _ in range(5):
            at = tuple(source.integers(0, s) for s in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = model.gradients(x, y)[0]
            w[at] = old - 1e-5
            down = model.gradients(x, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def personal(n, seed):
    source, rows = np.random.default_rng(seed), []
    for i in range(n):
        d = source.integers(0, 10, 20)
        mail = f"u{d[0]}{d[1]}.x@mail{d[2]}.example.com"
        phone = f"+1 ({d[3]}{d[4]}{d[5]}) 555-{d[6]}{d[7]}{d[8]}{d[9]}"
        ip = f"{d[10]}{d[11]}.{d[12]}.{d[13]}{d[14]}.{d[15]}"
        rows.append((i, f"{prose(i, 12)} {[mail, phone, ip][i % 3]} {prose(i + 500, 12)}"))
    return rows


def test_tagger_learns_and_base_spans_stay(spark):
    rows = personal(240, 5)
    model = pii.fit(documents(spark, rows[:180]), sample_docs=1000)
    held = [t for _, t in rows[180:]]
    base = [pii.base_spans(t) for t in held]
    alone = pii.find_spans(held, [[] for _ in held], model)
    same = sum(len(set(a) & set(b)) for a, b in zip(alone, base))
    assert same >= 0.8 * sum(map(len, base)) and same >= 0.8 * sum(map(len, alone))
    more = [*rows[180:], (1000, None), (1001, ""), (1002, "no data here"), (1003, "a " * 40_000 + held[0])]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, more), model).collect()}
    assert len(got) == len(more) and got[1000].spans == got[1001].spans == got[1002].spans == ""
    for i, t in more:
        own = pii.base_spans(t or "")
        assert set(pii.written(own).split(",")) <= set(got[i].spans.split(","))
        assert got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len([s for s in got[i].spans.split(",") if s])
    assert pii.personal_data(documents(spark, [(1, "plain")])).first().spans == ""
    assert pii.personal_data(empty(spark)).count() == 0


def test_reconciling_is_global():
    votes = {(0, 10, 3): 1, (8, 20, 3): 1, (12, 18, 3): 1, (30, 35, 1): 2}
    assert pii.reconcile([(32, 40, 0)], votes) == [(0, 10, 3), (12, 18, 3), (32, 40, 0)]


def test_unit_probabilities_are_normalised():
    model = lbl.LogBilinear(9, size=4)
    model.unit += 1
    before = np.array([[0, 1], [3, 2]])
    for row in before:
        p = np.exp([model.log_probability(row[None], np.array([u]))[0] for u in range(9)])
        assert abs(p.sum() - 1) < 1e-5


def test_scores_count_exactly_and_learn(spark):
    rows = [r for r in texts() if r[0] is not None] + [(100 + i, prose(i % 9, 200)) for i in range(60)]
    got = lbl.score_texts(documents(spark, rows)).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 3)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    usual = [r for r in got if r.held_out and r.n_known == r.n_tokens and r.n_tokens > 100]
    assert usual and sum(r.score for r in usual) > sum(r.base_score for r in usual)
    assert lbl.score_texts(empty(spark)).count() == 0
