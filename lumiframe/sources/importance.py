"""Consolidation of a tree of importance files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_importance_path


def read_importance_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all ``<root>/<target>/*.csv`` files with the facts of their paths, and the rest.

    Files are united by column name, in any order; a column that a file lacks is
    NULL in its rows. A column that holds only numbers becomes double. The second
    table lists (path) of files whose name does not follow the pattern.
    """
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = spark.read.text(f"{root}/*/*.csv", wholetext=True).withColumn("path", path)
    files = files.withColumn("facts", parse_importance_path("path"))
    unknown = files.where(F.col("facts").isNull()).select("path")
    # A file is one row, as it holds one value a position of the axis.
    lines = files.where(F.col("facts").isNotNull()).select("facts", F.split("value", "\r?\n").alias("lines"))
    lines = lines.withColumn("header", F.get("lines", F.lit(0)))
    width = lines.agg(F.max(F.size(F.split("header", ",")))).head()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda text: F.array(*[F.from_csv(text, schema)[f"c{i}"] for i in range(width)])
    named = (
        lines.select("facts", "header", F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
        .where("line != ''")
        .select("facts", F.arrays_zip(cells("header").alias("name"), cells("line").alias("value")).alias("cells"))
        .select("facts", F.map_from_entries(F.filter("cells", lambda c: c["name"].isNotNull())).alias("row"))
    )
    names = [r[0] for r in named.select(F.explode(F.map_keys("row")).alias("n")).distinct().orderBy("n").collect()]
    texts = [F.count_if(F.col("row")[n].isNotNull() & F.col("row")[n].try_cast("double").isNull()) for n in names]
    found = named.agg(F.count(F.lit(1)), *texts).head()
    kinds = {n: "string" if found[i + 1] else "double" for i, n in enumerate(names)}
    return named.select(*[F.col("row")[n].cast(kinds[n]).alias(n) for n in names], "facts.*"), unknown
