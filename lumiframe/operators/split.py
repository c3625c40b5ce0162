"""Stratified split and folds with exact per-class counts.

No row moves: a class is cut at exact order statistics of its hash order, and
each row compares its own (hash, key) with the cuts of its class, which are
joined to it. Class counts, sizes and cuts are tables, so there may be any number
of classes. Rows without a label belong to no class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_SEED
from ..functions.hashing import hash32
from ..functions.sizes import cut_lineage
from .ordering import cut_values, numbered, running

HISTOGRAM_BITS = 14


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n): rows per class."""
    return cut_lineage(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")))


def allocate(counts: DataFrame, label: str, draws: int) -> DataFrame:
    """(label, n, size): ``draws`` shared among the classes in proportion, by largest remainder."""
    total = counts.agg(F.sum("n")).head()[0]
    exact = F.col("n") / F.lit(total) * F.lit(draws)
    rows = counts.withColumns({"floor_": F.floor(exact).cast("long"), "rest_": F.floor(exact) - exact})
    left = draws - rows.agg(F.sum("floor_")).head()[0]
    placed = numbered(rows, [], ["rest_", label], "place_")
    return placed.select(label, "n", (F.col("floor_") + (F.col("place_") <= left).cast("long")).alias("size"))


def train_sizes(counts: DataFrame, label: str, fraction: float) -> DataFrame:
    """(label, n, size): training rows per class; the test side takes ceil((1 - fraction) * n) rows."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    if fraction == 1:
        return counts.withColumn("size", F.col("n"))
    total, classes, least = counts.agg(F.sum("n"), F.count(F.lit(1)), F.min("n")).head()
    n_test = math.ceil((1 - fraction) * (total or 0))
    n_train = (total or 0) - n_test
    if (least or 0) < 2:
        raise ValueError("every class needs at least two rows")
    if min(n_train, n_test) < classes:
        raise ValueError("both sides need at least one row per class")
    return allocate(counts, label, n_train)


def _hash_order(key: str, seed: int) -> tuple[dict[str, Column], Column]:
    h = hash32(seed, F.col(key))
    return {"order_hash_": h, "order_key_": F.col(key)}, F.shiftright(h, 32 - HISTOGRAM_BITS)


def _with_cuts(df: DataFrame, label: str, order: dict[str, Column], cuts: DataFrame) -> DataFrame:
    """Rows with ``cuts_``, how many cuts of their class there are, and ``passed_``, how many lie before them."""
    side = cuts.groupBy(F.col(label).alias("cut_label_")).agg(F.collect_list(F.struct(*order)).alias("at_"))
    side = cut_lineage(side)
    own = F.struct(*[c.alias(n) for n, c in order.items()])
    rows = df.join(side, F.col(label) == F.col("cut_label_"), "left")
    return rows.withColumns(
        {"cuts_": F.when(F.col("at_").isNull(), 0).otherwise(F.size("at_")), "passed_": F.size(F.filter("at_", lambda cut: own > cut))}
    ).drop("at_", "cut_label_")


def stratified_split(
    df: DataFrame, key: str, label: str, fraction: float, seed: int = DEFAULT_SEED, out: str = "is_train"
) -> DataFrame:
    """Add ``out``: whether the row belongs to the training side. Keys must be unique."""
    sizes = train_sizes(class_counts(df, label), label, fraction)
    if fraction == 1:
        return df.withColumn(out, F.lit(True))
    order, bucket = _hash_order(key, seed)
    wanted = sizes.where("size > 0").select(label, F.lit(0).alias("cut"), F.col("size").alias("rank"))
    rows = _with_cuts(df, label, order, cut_values(df, label, order, bucket, wanted))
    return rows.withColumn(out, (F.col("cuts_") > 0) & (F.col("passed_") == 0)).drop("cuts_", "passed_")


def fold_sizes(counts: DataFrame, label: str, k: int) -> DataFrame:
    """(label, n, upto): rows of a class in the folds up to each; the sorted labels are dealt to the folds in turn."""
    rows = running(counts, [], [label], sums={"end_": "n"})
    start = F.col("end_") - F.col("n")
    one = lambda i: F.greatest(F.lit(0), F.ceil((F.col("n") - F.pmod(F.lit(i) - start, F.lit(k))) / F.lit(k)))
    upto = [sum((one(i) for i in range(f + 1)), F.lit(0)).cast("long") for f in range(k)]
    return rows.select(label, "n", F.array(*upto).alias("upto"))


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int | None = None, out: str = "fold"
) -> DataFrame:
    """Add the fold 0..k-1, in hash order of ``seed`` or, without one, in key order.

    Keys must be unique. A row without a label has no fold.
    """
    counts = class_counts(df, label)
    if (counts.agg(F.max("n")).head()[0] or 0) < k:
        raise ValueError(f"no class has {k} rows")
    sizes = fold_sizes(counts, label, k)
    ends = sizes.select(label, F.posexplode("upto").alias("cut", "rank")).where((F.col("cut") < k - 1))
    wanted = cut_lineage(ends.where("rank > 0"))
    if seed is None:
        order = {"order_key_": F.col(key)}
        placed = numbered(df.select(label, F.col(key).alias("order_key_")), [label], ["order_key_"], "rank")
        cuts = placed.join(wanted, [label, "rank"]).select(label, "cut", "order_key_")
    else:
        order, bucket = _hash_order(key, seed)
        cuts = cut_values(df, label, order, bucket, wanted)
    rows = _with_cuts(df, label, order, cuts)
    # Folds without rows of a class come first and have no cut.
    fold = F.when(F.col(label).isNotNull(), F.col("passed_") + (k - 1) - F.col("cuts_"))
    fold = F.when((F.col("cuts_") == 0) & F.col(label).isNotNull(), F.lit(k - 1)).otherwise(fold)
    return rows.withColumn(out, fold.cast("int")).drop("cuts_", "passed_")
