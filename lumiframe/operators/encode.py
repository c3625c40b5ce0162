"""Label codes by sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .select import is_missing

MISSING_CODE = -1


def dictionary_of(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct non-missing values, coded 0.. in sorted order."""
    values = df.where(~is_missing(df, column)).select(F.col(column).alias("value")).distinct()
    coded = numbered(values, [], ["value"], "code")
    return coded.select("value", (F.col("code") - 1).cast("int").alias("code"))


def encode(df: DataFrame, column: str, out: str = "code") -> tuple[DataFrame, DataFrame]:
    """Add the code of ``column`` (-1 when missing); also returns the dictionary."""
    dictionary = dictionary_of(df, column)
    side = dictionary.select(F.col("value").alias("label_value"), F.col("code").alias("label_code"))
    coded = df.join(side, F.col(column) == F.col("label_value"), "left").withColumn(
        out, F.coalesce("label_code", F.lit(MISSING_CODE))
    )
    return coded.drop("label_value", "label_code"), dictionary


def decode(df: DataFrame, dictionary: DataFrame, code: str = "code", out: str = "label") -> DataFrame:
    """Add the value of a code; a code outside the dictionary gives NULL."""
    side = dictionary.select(F.col("code").alias("label_code"), F.col("value").alias(out))
    return df.join(side, F.col(code) == F.col("label_code"), "left").drop("label_code")
