"""The learner of decision lists against exhaustive search, and its way past a rule that fails."""

import itertools
import math

import numpy as np

from sparrowdex.llm import quality_rules as q


def test_the_first_test_has_the_highest_gain_of_all():
    rng = np.random.default_rng(3)
    for _ in range(10):
        x = np.round(rng.random((60, len(q.FEATURES))), 2)
        bad = x[:, 1] + 0.3 * rng.random(60) > 0.9
        base = math.log2(bad.sum() / len(bad))

        def gain(m, bad=bad, base=base):
            p, n = (bad & m).sum(), (~bad & m).sum()
            return p * (math.log2(p / (p + n)) - base) if p else 0.0

        best = 0.0
        for k in range(len(q.FEATURES)):
            values = np.unique(x[:, k])
            for at in (values[1:] + values[:-1]) / 2:
                best = max(best, gain(x[:, k] >= at), gain(x[:, k] < at))
        # With as many quantiles as rows every place between two values is tried, as in the exhaustive search.
        first = q.grow(x, bad, 1, 60 * 20)[0]
        assert abs(gain(first.holds(x)) - best) < 1e-9


def test_the_list_is_as_exact_as_the_best_pair_of_thresholds():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 10, (900, len(q.FEATURES))) / 10
    bad = (x[:, 0] >= 0.7) | (x[:, 4] < 0.2)
    rules = q.cover(x, bad, rng.random(900) < 0.67)
    got = np.logical_or.reduce([q.covers(r, x) for r in rules])
    best = max((((x[:, a] >= s) | (x[:, b] < t)) == bad).mean() for a, b in itertools.permutations(range(len(q.FEATURES)), 2) for s, t in itertools.product(np.arange(1, 10) / 10, repeat=2))
    assert best == 1.0 and (got == bad).mean() == 1.0


def test_the_search_goes_on_after_a_rule_that_fails():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (6000, len(q.FEATURES))) / 20
    # The first feature has the highest gain and is never precise; the third is precise and rarer.
    bad = (x[:, 0] >= 0.5) & (rng.random(6000) < 0.8) | (x[:, 2] >= 0.95)
    first = q.grow(x, bad, 1, 33)[0]
    assert first.feature == q.FEATURES[0]
    rules = q.cover(x, bad, rng.random(6000) < 0.67, tests=1)
    assert rules and all(r[0].feature == q.FEATURES[2] for r in rules)
    assert q.cover(x, rng.random(6000) < 0.3, rng.random(6000) < 0.67) == []


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "some words " * (20 + i), "x", 1, None) for i in range(40)], "doc_id long, text string, _qr_n_words string, n_words int, `a.b` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    out = q.kept_documents(docs, labels)
    assert out.columns == ["doc_id", "text", "n_words", "a.b"] and out.count() == 0  # all repeat themselves
