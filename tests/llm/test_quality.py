"""Quality: flattened trees against a plain walk, held-out rows, odd rows."""

import random
import zlib

import numpy as np
import pytest

from lumiframe.llm.quality import DEPTH, FEATURES, fit, quality, statistics


def walk(forest, row):
    total = forest.base
    for t in range(len(forest.leaf)):
        node = 0
        for _ in range(DEPTH):
            node = 2 * node + (2 if row[forest.feature[t, node]] > forest.cut[t, node] else 1)
        total += forest.leaf[t, node - forest.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_and_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    forest = fit(x, y, trees=30)
    scores = forest.score(x)
    assert np.allclose(scores[:200], [walk(forest, r) for r in x[:200]])
    assert ((scores > 0.5) == y).mean() > 0.98


def test_constant_features_and_one_class():
    assert fit(np.zeros((50, 2)), np.ones(50), trees=3).score(np.zeros((1, 2)))[0] > 0.9


@pytest.mark.parametrize("text", ["", "a", "\n\n", "é", "A B\nA B", "x " * 50000])
def test_statistics(text):
    found = statistics(text)
    assert len(found) == len(FEATURES) and all(np.isfinite(found))


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [rng.choice(["the", "river", "stone", "walks", "green", "under"]) + rng.choice(["", "s", "ed"]) for _ in range(40)]
        rows.append((i, " ".join(words).capitalize() + "." if good else "!! ".join(words).upper()))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_rows_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(None, "THE!! RIVER!!"), (9000, None), (9001, ""), (9001, ""), (9002, "word " * 50000)]
    docs = spark.createDataFrame([(d, t, "x", 0.0) for d, t in rows + odd], "doc_id bigint, text string, label string, score double")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, quality int")
    found = quality(docs, marks).collect()
    assert len(found) == len(rows) + len(odd)
    truth = dict(labels)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [tuple(r) for r in quality(docs, none).collect()] == [(1, False, 0.5, 1)]
    assert quality(docs.limit(0), none).collect() == []
