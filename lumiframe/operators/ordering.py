"""Order-dependent operators without one task per group.

``row_number`` and running totals over ``partitionBy(label)`` put a whole label
into one task. Here the rows are range-partitioned along the order and written
once with the number of their partition, the block. Blocks of one group follow
each other, the carry from earlier blocks is a small aggregate, and the window
runs per (group, block). Tables of all sizes take this path; adaptive execution
joins the ranges of a small one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import cut_lineage

BLOCK = "order_block_"


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column | str] | None = None,
    maxima: dict[str, Column | str] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima along ``order`` (unique within ``by``).

    ``sums`` and ``maxima`` map new column names to the values to accumulate.
    ``blocks`` sets the number of ranges, by default the shuffle partitions.
    """
    sums, maxima = sums or {}, maxima or {}
    by = list(by)
    order = list(order)
    tag = uuid.uuid4().hex[:8]
    block = f"{BLOCK}{tag}"
    values = {f"{name}_{tag}": value for name, value in {**sums, **maxima}.items()}
    rows = df.withColumns({n: F.col(v) if isinstance(v, str) else v for n, v in values.items()})
    ranges = rows.repartitionByRange(*([blocks] if blocks else []), *by, *order)
    rows = cut_lineage(ranges.withColumn(block, F.spark_partition_id()))

    total = [F.sum(f"{n}_{tag}").alias(f"{n}_{tag}") for n in sums]
    total += [F.max(f"{n}_{tag}").alias(f"{n}_{tag}") for n in maxima]
    totals = rows.groupBy(*by, block).agg(*total)
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(c).alias(f"{c}_{tag}") for c in by],
        F.col(block).alias(f"{block}_"),
        *[F.sum(f"{n}_{tag}").over(earlier).alias(f"{n}_{tag}_c") for n in sums],
        *[F.max(f"{n}_{tag}").over(earlier).alias(f"{n}_{tag}_c") for n in maxima],
    )
    same = F.col(block) == F.col(f"{block}_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_{tag}"))
    inside = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carry, same)
    out = out.withColumns(
        {n: F.sum(f"{n}_{tag}").over(inside) + F.coalesce(f"{n}_{tag}_c", F.lit(0)) for n in sums}
        | {n: F.greatest(F.max(f"{n}_{tag}").over(inside), F.col(f"{n}_{tag}_c")) for n in maxima}
    )
    return out.select(*df.columns, *sums, *maxima)


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str, blocks: int | None = None
) -> DataFrame:
    """1-based row number within ``by`` along ``order`` (unique within ``by``)."""
    return running(df, by, order, sums={out: F.lit(1).cast("long")}, blocks=blocks)


def competition_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str, descending: bool = True, blocks: int | None = None
) -> DataFrame:
    """Rank in which ties share the lowest number and gaps follow.

    Equal values collapse before the ranking, so a value shared by a third of
    all rows is one row there.
    """
    by = list(by)
    distinct = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    key = -F.col(value) if descending else F.col(value)
    ranked = running(distinct.where(F.col(value).isNotNull()), by, [key], sums={"upto": "ties"}, blocks=blocks)
    side = ranked.select(
        *[F.col(c).alias(f"{c}_r") for c in by],
        F.col(value).alias("value_r"),
        (F.col("upto") - F.col("ties") + 1).cast("int").alias(out),
    )
    same = F.col(value) == F.col("value_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return df.join(side, same, "left").select(*df.columns, out)


def cut_values(df: DataFrame, label: str, order: dict[str, Column], bucket: Column, wanted: DataFrame) -> DataFrame:
    """The order keys found at given ranks of each label.

    ``wanted`` has the columns of label, cut and rank. ``bucket`` must be
    non-decreasing along ``order``. A histogram (label, bucket) locates the bucket
    of each rank; only the rows of those buckets are sorted. The result has one
    row per wanted cut, with the columns of ``order`` at that rank.
    """
    narrow = df.select(label, bucket.alias(BLOCK), *[c.alias(n) for n, c in order.items()])
    histogram = narrow.groupBy(label, BLOCK).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(label).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    located = (
        histogram.withColumn("upto", F.sum("n").over(upto))
        .join(wanted, label)
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select(label, BLOCK, "cut", (F.col("rank") - F.col("upto") + F.col("n")).alias("residual"))
    )
    place = Window.partitionBy(label, "cut").orderBy(*order)
    return (
        narrow.join(cut_lineage(located), [label, BLOCK])
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") == F.col("residual"))
        .select(label, "cut", *order)
    )
