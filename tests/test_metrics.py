"""Metrics against recorded confusion matrices and against their definitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.operators import metrics as met
from lumiframe.operators import roc
from lumiframe.plans.search import BalancedAccuracyEvaluator

# Recorded confusion matrices with (balanced accuracy, F1, precision, accuracy).
GOLDENS = [
    ([[10, 2, 5], [0, 39, 0], [3, 4, 16]], 0.7612958227, 0.813606225, 0.8151991468, 0.8227848101),
    ([[10, 1, 2], [0, 31, 0], [0, 0, 17]], 0.9230769231, 0.9486531129, 0.9547832183, 0.9508196721),
    ([[12, 0, 2], [0, 33, 0], [2, 0, 15]], 0.9131652661, 0.9375, 0.9375, 0.9375),
    ([[4, 10, 2], [3, 26, 5], [3, 2, 13]], 0.5789760349, 0.6146238522, 0.6082817337, 0.6323529412),
    ([[1, 5, 1], [2, 16, 3], [1, 2, 9]], 0.5515873016, 0.6296363636, 0.616659699, 0.65),
    ([[10, 0, 0], [1, 21, 0], [2, 0, 9]], 0.9242424242, 0.9321866109, 0.946332737, 0.9302325581),
]


def pairs(spark, matrices):
    rows = [
        (g, t, p)
        for g, cm in enumerate(matrices)
        for t, line in enumerate(cm)
        for p, n in enumerate(line)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "g int, truth int, pred int")


def test_recorded_metrics(spark):
    df = pairs(spark, [g[0] for g in GOLDENS])
    rows = {r["g"]: r for r in met.metrics(df, "truth", "pred", ["g"]).collect()}
    for g, (_, balanced, f1, precision, acc) in enumerate(GOLDENS):
        assert rows[g]["balanced_accuracy"] == pytest.approx(balanced, abs=5e-10)
        assert rows[g]["f1"] == pytest.approx(f1, abs=5e-10)
        assert rows[g]["precision"] == pytest.approx(precision, abs=5e-10)
        assert rows[g]["acc"] == pytest.approx(acc, abs=5e-10)
        assert rows[g]["recall"] == pytest.approx(acc, abs=5e-10)
    cms = {r["g"]: r["cm"] for r in met.confusion_matrix(df, "truth", "pred", ["g"]).collect()}
    assert [cms[g] for g in range(len(GOLDENS))] == [g[0] for g in GOLDENS]


def test_evaluator_is_balanced_accuracy(spark):
    df = pairs(spark, [GOLDENS[0][0]]).withColumn("prediction", F.col("pred").cast("double"))
    assert BalancedAccuracyEvaluator(labelCol="truth").evaluate(df) == pytest.approx(GOLDENS[0][1], abs=5e-10)


def test_labels_seen_on_one_side_only(spark):
    df = spark.createDataFrame([(None, 0, 0), (None, 0, 2), (None, 1, 0)], "g string, truth int, pred int")
    counts = {(r["truth"], r["pred"]): r["n"] for r in met.confusion(df, "truth", "pred", ["g"]).collect()}
    assert len(counts) == 9 and sum(counts.values()) == 3 and counts[(2, 2)] == 0
    report = {r["label"]: r for r in met.class_report(df, "truth", "pred").collect()}
    assert report[1]["precision"] == 0.0 and report[2]["support"] == 0
    row = met.metrics(df, "truth", "pred").head()
    assert row["balanced_accuracy"] == pytest.approx(0.25)


def area(points):
    points = sorted([(0.0, 0.0), *points])
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(points))


@pytest.mark.parametrize("blocks", [None, 1, 5])
def test_auc_is_area_and_pair_share(spark, blocks):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 400)
    proba = np.round(rng.dirichlet([1, 1, 1], 400), 1)
    proba[:150, 0] = 0.3  # one score holds a third of the rows
    df = spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(truth, proba)], "t int, p array<double>")
    aucs = {r["class"]: r["auc"] for r in roc.auc_per_class(df, "t", "p", blocks=blocks).collect()}
    points = roc.roc_points(df, "t", "p", blocks=blocks).collect()
    for c in range(3):
        pos, neg = proba[truth == c, c], proba[truth != c, c]
        share = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        assert aucs[c] == pytest.approx(share)
        assert area([(r["fpr"], r["tpr"]) for r in points if r["class"] == c]) == pytest.approx(share)
    assert roc.auc_ovr(df, "t", "p").head()["auc"] == pytest.approx(np.mean(list(aucs.values())))


def test_auc_is_zero_without_every_class(spark):
    df = spark.createDataFrame([(0, [0.5, 0.3, 0.2]), (1, [0.1, 0.8, 0.1])], "t int, p array<double>")
    assert roc.auc_ovr(df, "t", "p").head()["auc"] == 0.0


def test_two_classes(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.6, 0.4]), (0, [0.5, 0.5]), (1, [0.2, 0.8])], "t int, p array<double>")
    values = {r["auc"] for r in roc.auc_per_class(df, "t", "p").collect()}
    assert values == {0.75}


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    assert [r[0] for r in df.select(met.argmax("p")).collect()] == [0, 2]
