"""Wide measurement tables: one column per position of the axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import METADATA_COLUMNS, MISSING_TOKENS, TEXT_METADATA
from ..operators.select import require_same_columns


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def feature_columns(columns: Sequence[str], metadata: Sequence[str] = METADATA_COLUMNS) -> list[str]:
    """All columns that are not descriptive, in table order."""
    known = set(metadata)
    return [c for c in columns if c not in known]


def axis_of(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(pos, wavenumber) from column names; a name that is not a number is an error."""
    rows = []
    for i, name in enumerate(names):
        try:
            rows.append((i, float(name)))
        except ValueError:
            raise ValueError(f"column {name!r} is neither descriptive nor a position of the axis") from None
    return spark.createDataFrame(rows, "pos int, wavenumber double")


def pack(
    df: DataFrame, metadata: Sequence[str] = METADATA_COLUMNS, out: str = "spectrum"
) -> tuple[DataFrame, DataFrame]:
    """The descriptive columns and one array column; also returns the axis."""
    names = feature_columns(df.columns, metadata)
    if not names:
        raise ValueError("no measured columns")
    axis = axis_of(df.sparkSession, names)
    kept = [F.col(quoted(c)) for c in df.columns if c not in set(names)]
    return df.select(*kept, F.array(*[F.col(quoted(c)).cast("double") for c in names]).alias(out)), axis


def unpack(df: DataFrame, names: Sequence[str], column: str = "spectrum") -> DataFrame:
    """The array column as one column per name."""
    kept = [F.col(quoted(c)) for c in df.columns if c != column]
    return df.select(*kept, *[F.get(column, F.lit(i)).alias(n) for i, n in enumerate(names)])


def cleaned(column: Column) -> Column:
    """NULL for texts that stand for a missing value."""
    return F.when(~F.trim(column).isin(*MISSING_TOKENS), column)


def wide_schema(columns: Sequence[str], text: Sequence[str] = TEXT_METADATA) -> T.StructType:
    kinds = {c: T.StringType() for c in text}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in columns])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV table; reads its header only."""
    return spark.read.option("header", True).csv(path).columns


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str], text: Sequence[str] = TEXT_METADATA) -> DataFrame:
    """Scan with a declared schema. A number cell that is no number becomes NULL."""
    df = (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("maxColumns", max(20480, len(columns) + 1))
        .schema(wide_schema(columns, text))
        .csv(path)
    )
    texts = {c for c in columns if c in set(text)}
    return df.select([cleaned(F.col(quoted(c))).alias(c) if c in texts else F.col(quoted(c)) for c in columns])


def read_wide(
    spark: SparkSession,
    path: str,
    metadata: Sequence[str] = METADATA_COLUMNS,
    text: Sequence[str] = TEXT_METADATA,
    fmt: str = "csv",
) -> tuple[DataFrame, DataFrame]:
    """Packed table and axis of a wide CSV or Parquet table."""
    if fmt == "parquet":
        return pack(spark.read.parquet(path), metadata)
    return pack(scan_csv(spark, path, header_of(spark, path), text), metadata)


def read_for_scoring(
    spark: SparkSession,
    path: str,
    example: str,
    metadata: Sequence[str] = METADATA_COLUMNS,
    text: Sequence[str] = TEXT_METADATA,
) -> tuple[DataFrame, DataFrame]:
    """Packed table and axis of new rows whose columns must be those of an example file.

    The order of the columns is free; the array follows the example.
    """
    expected = header_of(spark, example)
    df = scan_csv(spark, path, header_of(spark, path), text)
    return pack(require_same_columns(df, expected).select([F.col(quoted(c)) for c in expected]), metadata)
