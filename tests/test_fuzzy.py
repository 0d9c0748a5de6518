import random
from difflib import SequenceMatcher

from talentloom.operators.fuzzy import best_fuzzy, fuzzy_pairs


def test_no_pair_is_lost_against_brute_force(spark):
    rng = random.Random(7)
    words = {"angular", "angularjs", "vue", "vuex", "postgresql", "postgres", "node.js", "nodejs", "a", "ab", "n3", "n4"}
    for _ in range(250):
        base = "".join(rng.choice("abcde -.") for _ in range(rng.randint(1, 16)))
        words.add(base)
        edited = list(base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(edited) + 1)
            if rng.random() < 0.5 and edited:
                edited.pop(min(at, len(edited) - 1))
            else:
                edited.insert(at, rng.choice("abcde -."))
        if edited:
            words.add("".join(edited))
    words = sorted(words)
    half = len(words) // 2
    names, tokens = words[:half] + words[half : half + 40], words[half:]
    expected = {
        (a, b)
        for a in names
        for b in tokens
        if SequenceMatcher(None, a, b).ratio() >= 0.85
    }
    got = fuzzy_pairs(
        spark.createDataFrame([(w,) for w in names], "name string"),
        spark.createDataFrame([(w,) for w in tokens], "name string"),
    ).collect()
    assert {(r["a"], r["b"]) for r in got} == expected and len(expected) > 60
    assert len(got) == len(expected)


def test_best_match_prefers_the_smaller_token_on_ties(spark):
    names = spark.createDataFrame([("widgets",)], "name string")
    tokens = spark.createDataFrame([("widgetsx",), ("widgetsa",), ("other",)], "name string")
    assert [tuple(r)[:2] for r in best_fuzzy(names, tokens).collect()] == [("widgets", "widgetsa")]
