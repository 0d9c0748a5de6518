"""Blocked products against plain numpy, with skew and awkward vectors."""

import numpy as np
import pytest

from talentloom.operators.blocks import pair_cosines


@pytest.mark.parametrize("per_cell", (50, 10_000))
def test_pair_cosines(spark, per_cell):
    source = np.random.default_rng(4)
    left, right = source.normal(size=(300, 8)).astype(np.float32), source.normal(size=(40, 8)).astype(np.float32)
    a = {f"c{i}": v.tolist() for i, v in enumerate(left)} | {"zero": [0.0] * 8, "empty": [], "null": None, "hole": [None] + [1.0] * 7, "short": [1.0] * 5}
    b = dict(enumerate(right.tolist())) | {100: [1.0] * 5, 101: [0.0] * 8}
    pairs = [(f"c{i}", 0) for i in range(300)] + [("c1", j) for j in range(40)] + [(f"c{i}", i % 40) for i in range(300)]
    pairs += [(x, j) for x in ("zero", "empty", "null", "hole", "short", "absent", None) for j in (3, 100, 101, 999, None)]
    shown = {}
    for r in pair_cosines(
        spark.createDataFrame(pairs, "cv_id string, jd_id long"), spark.createDataFrame(list(a.items()), "cv_id string, embedding array<float>"),
        spark.createDataFrame(list(b.items()), "jd_id long, embedding array<float>"), per_cell=per_cell,
    ).collect():
        assert (r.cv_id, r.jd_id) not in shown
        shown[r.cv_id, r.jd_id] = (r.cosine, r.problem)
    assert set(shown) == set(pairs)
    for (x, y), (cosine, problem) in shown.items():
        v, w = a.get(x), b.get(y)
        if not v or not w or None in v or len(v) != len(w):
            assert cosine is None and problem == ("vector length" if v and w and len(v) != len(w) else None)
            continue
        v, w = np.array(v, np.float64), np.array(w, np.float64)
        size = np.sqrt((v @ v) * (w @ w))
        assert cosine == pytest.approx(v @ w / size if size else 0.0, abs=1e-12) and problem is None


def test_no_pairs(spark):
    none = spark.createDataFrame([], "cv_id long, jd_id long")
    assert pair_cosines(none, none.selectExpr("cv_id", "array(1.0F) AS embedding"), none.selectExpr("jd_id", "array(1.0F) AS embedding")).count() == 0
