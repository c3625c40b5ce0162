"""Labelled rows, and bounded draws of texts for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A draw is a share of the hash range in steps of this many parts.
PARTS = 1 << 24


def held_out(key: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text falls into ``part``; a null key is not held out."""
    rest = F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts
    return F.coalesce(rest == part, F.lit(False))


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) with an empty text for null."""
    return df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def label_of(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(id, label) with one row a key; the larger label wins, rows without key or label go."""
    rows = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    return rows.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))


def drawn(df: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` of ``n`` rows by a hash of their text, so that copies come or stay away together."""
    share = PARTS if n <= wanted else max(1, round(PARTS * wanted / n))
    return df.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(PARTS)) < share)


def distinct_texts(df: DataFrame, bound: int) -> DataFrame:
    """One row of each text, with its largest label, and not more than ``bound`` of them."""
    digest = F.sha2("text", 256).alias("digest")
    return df.groupBy(digest).agg(F.max("label").alias("label"), F.first("text").alias("text")).limit(bound)
