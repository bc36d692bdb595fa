"""Operators 2 and 6: held-out accuracy, the linear scan against brute force, awkward tables."""

import random

import numpy as np
import pytest

from bibspark.llm import logistic, quality, toxicity
from bibspark.llm.common import fold

BAD = ["vile", "scummy", "wretched", "rotten"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(vocab) for _ in range(r.randint(20, 200))]
        toxic, junk = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        text = " ".join(w)
        docs.append((i, " ".join(x.upper() + "!!" for x in text.split()) if junk else text))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "\n "), (None, "some text"), (0, docs[0][1])]
    labels += [(5003, 1, 0), (None, 0, 1), (1, None, None), (0, labels[0][1], labels[0][2])]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as label", "2 as fold", "3 as score", "4 as n"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(scored, column, truth, labels):
    rows = scored.join(labels.where("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id").where(fold(scored.doc_id) == 2).where(f"{truth} is not null").collect()
    return np.mean([(r[column] >= 0.5) == bool(r[truth]) for r in rows])


def test_quality(spark, corpus):
    docs, labels = corpus
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.count() == docs.count() and scored.columns == [*docs.columns, "quality_score"]
    assert held_out(scored, "quality_score", "quality", labels) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 650 < kept.count() < 800


def test_toxicity(spark, corpus):
    docs, labels = corpus
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert scored.count() == docs.count()
    assert held_out(scored, "toxicity", "toxic", labels) > 0.95
    assert all(0 <= r.toxicity <= 1 for r in scored.collect())


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.quality_score for r in quality.score(docs, quality.fit(docs, none)).collect()}) <= 2
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(empty, quality.fit(docs, none)).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def brute_segments(s):
    """Maximal scoring segments by recursion: the best one, then left and right of it."""
    if not len(s):
        return []
    best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3], best[4]
    left = brute_segments(s[:i])
    right = [(a + j, b + j, v) for a, b, v in brute_segments(s[j:])]
    return [*left, (i, j, best[0]), *right]


def test_segments():
    r = random.Random(4)
    for _ in range(200):
        s = [float(r.choice([-3, -2, -1, 1, 2, 3])) + r.random() / 100 for _ in range(r.randint(0, 14))]
        got = [(a, b, round(v, 6)) for a, b, v in toxicity.segments(np.array(s))]
        assert got == [(a, b, round(v, 6)) for a, b, v in brute_segments(s)]


def test_decay():
    scores, share = np.array([1.0, -1.0]), np.array([0.25, 0.75])
    assert abs(toxicity.decay(scores, share) - np.log(3)) < 1e-6


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 2))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.abs(logistic.fit(x, y) - [1, 2, -1]).max() < 0.3
    assert logistic.predict(logistic.fit(x[:3], np.ones(3)), x[:1])[0] > 0.5
