"""Manifests against a tree built level by level in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from talentloom.llm import merkle
from tests.llm.cases import documents, texts

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes):
    """All levels of the tree, and for every place its siblings on the way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    ways = []
    for place in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            run = place // 8 * 8
            way.append(("".join(level[run:place]), "".join(level[place + 1 : run + 8])))
            place //= 8
        ways.append(way)
    return levels[-1][0], ways


def expected(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0], leaf(r), r))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees[lang] = up([t[1] for t in by_lang[lang]])
    root, tops = up([trees[v][0] for v in langs])
    out = []
    for n, lang in enumerate(langs):
        for (key, own, row), way in zip(by_lang[lang], trees[lang][1], strict=True):
            way, at = way + tops[n], own
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0:
                at = leaf((*row[:4], row[4] and row[4].translate(UPPER)))
            for left, right in way:
                at = h(left, at, right)
            out.append((key, own, trees[lang][0], root, h(*(a + b for a, b in way)), at, at == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, place int")
    got = [tuple(r) for r in merkle.manifest(df).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


@pytest.mark.parametrize("sizes", ((1,), (9, 1, 8), (2,) * 9 + (1,) * 3))
def test_manifest(spark, sizes):
    rows = [(100 * n + i, None if i % 5 == 0 else "s", "é" * n or None, i, f"Text {i} É") for n, size in enumerate(sizes) for i in range(size)]
    check(spark, rows)


def test_deep_trees_hot_partition_and_awkward_rows(spark):
    rows = [(i, "s", "en", 3, "Abc" if i % 2 else "abc") for i in range(700)]
    rows += [(i, "s", f"l{i % 70}", 3, None) for i in range(1000, 1100)]
    rows += [(None, None, None, None, None), (None, None, None, None, ""), (5, "s", "en", 3, "Abc"), (5, "s", "en", 3, "Abc"), (5, "t", "en", 3, "Z" * 200_000)]
    check(spark, rows)


def test_tables_of_awkward_documents(spark):
    df = documents(spark)
    got = merkle.manifest(df)
    assert got.count() == len(texts()) and got.where("NOT verified").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0).count() == 0
    assert merkle.manifest(df.limit(0)).count() == 0
