"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _least(sides: DataFrame) -> DataFrame:
    return sides.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the smallest neighbour."""
    sides = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = sides.join(_least(sides), "u").where("v > u")
    return moved.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame, scratch: Scratch, label: str = "stars") -> DataFrame:
    """(node, root) of every node that is not the smallest of its component.

    ``edges`` has bigint columns ``u`` and ``v``. Each round is one written table;
    rounds grow with the logarithm of the longest path. Only a count and a
    checksum come to the driver. No edges give no rows.
    """
    current = scratch.table(edges.select("u", "v").where("u != v"), f"{label}-0")
    before, step = None, 0
    while (now := _state(current)) != before:
        before, step = now, step + 1
        following = scratch.table(_small_star(_large_star(current)), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        current = following
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
