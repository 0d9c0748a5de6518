"""Toxicity: held-out accuracy, calibration, trees, features, awkward rows."""

import random
import zlib

import numpy as np

from talentloom.llm import toxicity
from talentloom.llm.common import table
from tests.llm.cases import documents, prose, texts

FOLDER = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    found = toxicity.toxicity(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    rows = found.where("held_out").join(table(spark, FOLDER, "labels"), "doc_id").select("score", "predicted", "toxic").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("toxic", "predicted", "score"))
    caught, spared = p[y == 1].mean(), 1 - p[y == 0].mean()
    assert len(rows) > 500 and caught > 0.9 and spared > 0.98
    assert ((s >= 0) & (s <= 1)).all() and abs(s.mean() - y.mean()) < 0.03


def test_awkward_rows(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, None, "x"), (2, 1, "x"), (2, 0, "x"), (None, 1, "x"), (3, 0, "x"), (10, 1, "x"), (11, 0, "x"), (99, 1, "x"), (60, 0, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    none = toxicity.toxicity(df, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    source = random.Random(5)
    rows = [(i, prose(i, 40) + (" zorgel" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows if i not in held]
    changed = labels + [(i, source.randrange(2)) for i in held]
    one, other = (toxicity.toxicity(docs, spark.createDataFrame(r, "doc_id long, toxic int")).orderBy("doc_id").collect() for r in (labels, changed))
    assert one == other and all(r.predicted == (r.doc_id % 3 == 0) for r in one if r.held_out)


def test_features_see_disguise_address_and_capitals():
    book = toxicity.Lexicon({"zorgel": 3.0}, {"bloo": 2.0})
    at = {f: i for i, f in enumerate(toxicity.FEATURES)}
    plain = toxicity.features("a fine day for a walk", book)
    assert plain[at["insults"]] == plain[at["disguised_hits"]] == plain[at["near_second_person"]] == 0
    assert toxicity.features("1d10t! st*pid m.o.r.o.n z0rgel", book)[at["disguised_hits"]] == np.log1p(4)
    assert toxicity.features("what an i d i o t he is", book)[at["spaced_hits"]] == np.log1p(1)
    assert toxicity.features("you utter moron", book)[at["near_second_person"]] > 0 == toxicity.features("you " + "and " * 9 + "moron", book)[at["near_second_person"]]
    assert toxicity.features("LOUD words HERE!!", book)[at["capital_words"]] > 0 < toxicity.features("no!! way??", book)[at["repeated_marks"]]
    assert toxicity.features("blooper blooming", book)[at["beginning_distinct"]] == np.log1p(1)
    assert len(toxicity.features(None, book)) == len(toxicity.features("x" * 400_000, book)) == len(toxicity.FEATURES)


def test_isotonic_is_the_least_squares_step():
    source = np.random.default_rng(1)
    x = source.integers(0, 12, 60).astype(float)
    y = (source.random(60) < x / 12).astype(float)
    places, values = toxicity.isotonic(x, y)
    assert (np.diff(values) >= 0).all()
    for i in range(len(places)):  # the minimax formula
        lower = max(min(y[(x >= places[a]) & (x <= places[b])].mean() for b in range(i, len(places))) for a in range(i + 1))
        assert abs(values[i] - lower) < 1e-12


def test_trees_lower_the_loss_and_split_exactly():
    source = np.random.default_rng(2)
    x = source.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = toxicity.boost(x, y, rounds=60)
    assert ((trees.margin(x) > 0) == (y > 0.5)).mean() > 0.97
    one = toxicity.boost(x, (x[:, 1] > 0).astype(float), rounds=1, depth=1)
    assert one.splits[0][0][0] == 1
