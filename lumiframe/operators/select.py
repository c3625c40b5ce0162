"""Row selection and validity checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = "spectrum"


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN where the type has it."""
    missing = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        missing |= F.isnan(column)
    return missing


def valid_spectrum(features: str = FEATURES) -> Column:
    """All values present and at least one of them not zero."""
    present = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.col(features).isNotNull() & present & F.exists(features, lambda x: x != 0)


def valid_rows(df: DataFrame, target: str, features: str = FEATURES) -> DataFrame:
    return df.where(~is_missing(df, target) & valid_spectrum(features))


def some_values(df: DataFrame, column: str, limit: int = 100) -> str:
    """Distinct values of a column for a message, which says where it is cut."""
    found = sorted(str(r[0]) for r in df.select(column).distinct().limit(limit + 1).collect())
    return ", ".join(found[:limit]) + (", and more" if len(found) > limit else "")


def select_samples(
    df: DataFrame,
    target: str,
    sample_type: str,
    group: str | None = None,
    features: str = FEATURES,
    type_column: str = "sample_type",
    group_column: str = "group_fam",
) -> DataFrame:
    """Valid rows of one sample type, optionally of one group.

    An absent target column becomes the constant label 1. An unknown sample type
    and a target without any value are errors; both come from one small check.
    """
    chosen = df.where(F.col(type_column) == sample_type)
    if group:
        chosen = chosen.where(F.col(group_column) == group)
    if target not in df.columns:
        chosen = chosen.withColumn(target, F.lit(1.0))
    if not chosen.where(~is_missing(chosen, target)).take(1):
        if not df.where(F.col(type_column) == sample_type).take(1):
            raise ValueError(f"no sample type {sample_type!r}; available: {some_values(df, type_column)}")
        raise ValueError(f"no value of {target!r} among rows of {sample_type!r}")
    return valid_rows(chosen, target, features)


def validation_report(df: DataFrame, target: str, by: Iterable[str], features: str = FEATURES) -> DataFrame:
    """Per group: rows, rows with a target, valid rows, and whether all or any are valid."""
    ok = ~is_missing(df, target) & valid_spectrum(features)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~is_missing(df, target)).alias("n_target"),
        F.count_if(ok).alias("n_valid"),
        F.bool_and(ok).alias("all_valid"),
        F.bool_or(ok).alias("any_valid"),
    )


def require_same_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` when its column set equals ``columns``; the order is free."""
    expected, found = set(columns), set(df.columns)
    if expected != found:
        raise ValueError(
            f"columns differ: missing {sorted(expected - found)}, unexpected {sorted(found - expected)}"
        )
    return df


def example_row(df: DataFrame) -> DataFrame:
    """One row that shows the schema."""
    return df.limit(1)
