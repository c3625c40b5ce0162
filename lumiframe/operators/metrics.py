"""Classification metrics from counted (truth, prediction) pairs.

One aggregate with map-side combining counts the pairs; everything else works on
that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BALANCED_ACCURACY_GATE


def argmax(probabilities: Column | str) -> Column:
    """0-based position of the largest entry, the first on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def pair_counts(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    kind = df.schema[truth].dataType
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).cast(kind).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., truth, pred, n) over all labels seen on either side, zero-filled."""
    by = list(by)
    counts = pair_counts(df, truth, pred, by)
    labels = F.array_sort(F.array_union(F.collect_set("truth"), F.collect_set("pred")))
    grid = (
        counts.groupBy(*by)
        .agg(labels.alias("labels"))
        .withColumn("truth", F.explode("labels"))
        .withColumn("pred", F.explode("labels"))
        .select(*by, "truth", "pred", F.lit(0).cast("long").alias("n"))
    )
    return grid.unionByName(counts).groupBy(*by, "truth", "pred").agg(F.sum("n").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., labels, cm): rows true, columns predicted, in sorted label order."""
    by = list(by)
    rows = (
        confusion(df, truth, pred, by)
        .groupBy(*by, "truth")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pred", "n"))), lambda x: x["n"]).alias("line"))
    )
    lines = F.array_sort(F.collect_list(F.struct("truth", "line")))
    return rows.groupBy(*by).agg(
        F.transform(lines, lambda x: x["truth"]).alias("labels"),
        F.transform(lines, lambda x: x["line"]).alias("cm"),
    )


def class_report(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; a ratio without rows is 0."""
    by = list(by)
    counts = pair_counts(df, truth, pred, by)
    # Each pair is counted once under its true and once under its predicted label.
    sides = F.explode(
        F.array(
            F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
        )
    )
    hit = F.when((F.col("truth") == F.col("pred")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    per_label = (
        counts.select(*by, "truth", "pred", "n", sides.alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum(hit).alias("hits"))
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return per_label.select(
        *by,
        "label",
        "support",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "hits",
    )


def metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and support-weighted precision, recall and F1."""
    by = list(by)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    # Added up in label order, so that a value at the gate falls on the same side in every run.
    recalls = F.array_sort(F.collect_list(F.when(F.col("support") > 0, F.struct("label", "recall"))))
    mean_recall = F.aggregate(recalls, F.lit(0.0), lambda total, r: total + r["recall"]) / F.size(recalls)
    return (
        class_report(df, truth, pred, by)
        .groupBy(*by)
        .agg(
            (F.sum("hits") / F.sum("support")).alias("acc"),
            mean_recall.alias("balanced_accuracy"),
            weighted("precision").alias("precision"),
            weighted("recall").alias("recall"),
            weighted("f1").alias("f1"),
            F.sum("support").alias("n"),
        )
    )


def log_loss(df: DataFrame, truth: str, proba: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of -ln of the probability given to the true label (an index into ``proba``)."""
    eps = 2.220446049250313e-16
    p = F.least(F.greatest(F.get(proba, F.col(truth)), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*by).agg(F.avg(-F.log(p)).alias("log_loss"))


def passes_gate(metric: str = "balanced_accuracy", threshold: int = BALANCED_ACCURACY_GATE) -> Column:
    return F.col(metric) >= threshold / 100


def unit_share(value: str, by: Sequence[str] = ()) -> Column:
    """Value divided by the sum over its group; for small tables such as importances."""
    return F.col(value) / F.sum(value).over(Window.partitionBy(*by))
