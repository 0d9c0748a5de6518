"""Packing round trips and mixing invariants."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from talentloom.llm import mixing, packing
from tests.llm.cases import documents, empty, texts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(tokenizer):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})
    odd = ["", " ", "  a  b ", "a\n\n b", "x <|endoftext|>y", "it's  we'll\t a ", "a \x1c b", "日本 語  12 3", "  a", "é ñ"]
    for text in odd + [t for _, t in texts() if t]:
        assert tokenizer.encode(text, add_special_tokens=False).ids == encoder.ids(text).tolist()


def test_pieces_and_places_round_trip(spark, tokenizer):
    rows = texts()
    got = packing.pack_documents(documents(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    check_layout([(r.sequence_id, r.offset, r.length) for r in got])


def check_layout(places):
    rows = defaultdict(list)
    for sequence, offset, length in places:
        rows[sequence].append((offset, length))
    for held in rows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_length_once_and_fits(counts):
    plan = packing.plan_packing(counts, 64)
    used = Counter()
    for pattern, times in plan:
        assert sum(length * n for length, n in pattern) <= 64
        for length, n in pattern:
            used[length] += n * times
    assert used == Counter(counts)
    assert sum(times for _, times in plan) <= 2 * math.ceil(sum(k * v for k, v in counts.items()) / 64) + 1


def test_complements_fill_exactly():
    for counts in ({40: 7, 24: 7}, {30: 2, 20: 2, 14: 2}, {31: 3, 16: 3, 10: 3, 7: 3}):
        assert sum(n for _, n in packing.plan_packing(counts, 64)) == sum(k * v for k, v in counts.items()) // 64


def test_large_counts_stay_a_small_plan():
    source = random.Random(1)
    counts = {n: source.randrange(10**9) for n in range(1, 1025)}
    plan = packing.plan_packing(counts)
    assert len(plan) < 5000
    assert sum(n for _, n in plan) <= 1.05 * sum(k * v for k, v in counts.items()) / 1024


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(empty(spark)).count() == 0


def shares(rows):
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens
    return got


def corpus(spark):
    rows = [(i, "w " * (20 + i % 7)) for i in range(900)]
    full = [(i, t, "a" if i % 10 < 7 else "b" if i % 10 < 9 else None) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string")


def test_entropy_is_met_and_budget_kept(spark):
    docs = corpus(spark)
    got = mixing.mix(docs, entropy_share=0.95, block_tokens=2000, range_docs=50).collect()
    total = sum(20 + i % 7 + 1 for i in range(900))
    part = shares(got)
    entropy = -sum(v / sum(part.values()) * math.log(v / sum(part.values())) for v in part.values())
    assert abs(entropy - 0.95 * math.log(3)) < 0.01 and 0.98 * total <= sum(part.values()) <= total
    blocks = Counter(r.block for r in got)
    assert len(blocks) == math.ceil(total / 2000) and max(blocks.values()) < 2 * min(blocks.values())
    assert max(Counter((r.doc_id, r.copy) for r in got).values()) == 1
    assert len({r.copy for r in got if r.source is None}) > 1


def test_exponent_is_bisected_to_the_limit(spark):
    docs = corpus(spark)
    sources = mixing._keyed(docs, "doc_id", "source", "text").groupBy("source").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "tokens")
    total = sources.groupBy().sum("tokens").first()[0]
    exponent = mixing.bisect_exponent(sources, total, repetition=1.5)
    tokens = [r.tokens for r in sources.collect()]
    weights = [t**exponent for t in tokens]
    assert abs(max(w / sum(weights) * total / t for w, t in zip(weights, tokens)) - 1.5) < 1e-4


def test_whole_mixture_drops_nothing(spark):
    docs = documents(spark)
    mixed = mixing.mixed_documents(docs, repetition=1.5)
    assert mixed.columns == docs.columns
    before, after = (Counter((r.doc_id, r.text) for r in d.collect()) for d in (docs, mixed))
    assert set(before) == set(after) and all(after[k] >= before[k] for k in before)
    assert mixing.mixed_documents(empty(spark), repetition=1.5).count() == 0
    assert mixing.mix(empty(spark), entropy_share=0.9).count() == 0
