"""Result files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import append_log
from ..operators.select import example_row


def save_results(tables: dict[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Each table under ``<root>/<name>``, one folder per target."""
    for name, df in tables.items():
        df.write.partitionBy("target_variable").mode(mode).option("header", True).format(fmt).save(f"{root}/{name}")


#: Fixed names of the result files of a target; {} is the suffix.
RESULT_FILES = {
    "results_summary": ("results_summary{}", "csv"),
    "back_projection": ("results_summary{}_back_projection", "csv"),
    "grid_search_results": ("grid_search_results_{}_back_projection", "csv"),
    "cross_validation": ("results_summary{}_cross", "json"),
}


def save_target_results(tables: dict[str, DataFrame], root: str, target: str, group: str | None = None) -> None:
    """The four result tables of one target under ``<root>/<target>``, named after the group or else the target."""
    for name, df in tables.items():
        stem, fmt = RESULT_FILES[name]
        path = f"{root}/{target}/{stem.format(f'_{group or target}')}.{fmt}"
        df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def save_log(new: DataFrame, path: str, key: str = "run_id") -> DataFrame:
    """Append to an experiment log; the first row of a run stays. Returns the new log.

    Only rows of unknown runs are written, so the stored part is never rewritten.
    """
    spark = new.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        fresh = append_log(old.limit(0), new, key).join(old.select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)
    else:
        append_log(new.limit(0), new, key).write.parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def save_example(df: DataFrame, path: str) -> None:
    """One row that shows the schema."""
    example_row(df).write.mode("overwrite").parquet(path)


def save_predictions(df: DataFrame, path: str, key: str = "id", fmt: str = "csv") -> None:
    columns = [c for c in (key, "predictions", "label") if c in df.columns]
    df.select(*columns).write.mode("overwrite").option("header", True).format(fmt).save(path)


def save_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def save_named(df: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Write each row's text to the file ``<root>/<path>`` and return the number of files.

    The rows are dealt out to all cores, as many files may come from a short table in
    one partition. Tasks write to a hidden name and rename it, so no reader sees half a
    file and a repeated task replaces its files by equal ones. Rows must name different files;
    a null path is an error, a null text an empty file.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch["path"], batch["text"]):
                folder, _, last = f"{base}/{name}".rpartition("/")
                system.create_dir(folder, recursive=True)
                hidden = f"{folder}/.{last}.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as out:
                    out.write((content or "").encode())
                if system.get_file_info(f"{folder}/{last}").type != pyarrow.fs.FileType.NotFound:
                    system.delete_file(f"{folder}/{last}")
                system.move(hidden, f"{folder}/{last}")
            yield pd.DataFrame({"n": [len(batch)]})

    names = F.coalesce(F.col(path), F.raise_error(F.lit("a file needs a name"))).alias("path")
    dealt = df.select(names, F.col(text).alias("text")).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(written, "n long").agg(F.sum("n")).head()[0] or 0
