"""Experiment configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_SCHEMA = (
    "experiment_name string, run_name string, selected_group_fam string, searchs_hipermetrics array<string>, "
    "model_types_to_train array<string>, train_percentages array<double>, sample_types array<string>, "
    "targets_to_predict array<string>, scale array<boolean>, apply_pls array<boolean>, "
    "apply_smote_resampling array<boolean>, n_components array<int>"
)

# What an absent key stands for; the other lists are empty.
EXPERIMENT_NAME = "FTIR Supervised Training"
RUN_NAME = "demo"
FLAG = True
COMPONENTS = 10


def with_defaults(config: DataFrame) -> DataFrame:
    """Absent keys replaced by their defaults."""
    flags = F.array(F.lit(FLAG))
    texts = F.array().cast("array<string>")
    fill = {
        "experiment_name": F.lit(EXPERIMENT_NAME),
        "run_name": F.lit(RUN_NAME),
        "searchs_hipermetrics": texts,
        "model_types_to_train": texts,
        "train_percentages": F.array().cast("array<double>"),
        "sample_types": texts,
        "targets_to_predict": texts,
        "scale": flags,
        "apply_pls": flags,
        "apply_smote_resampling": flags,
        "n_components": F.array(F.lit(COMPONENTS)),
    }
    return config.withColumns({c: F.coalesce(c, d) for c, d in fill.items()})


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """One configuration per file, with defaults."""
    return with_defaults(spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True))
