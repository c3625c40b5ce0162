"""Standardisation with population deviation."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_statistics(df: DataFrame, features: str, by: list[str] | None = None) -> DataFrame:
    """Per position: mean and population deviation, in long form.

    The vector is summarised in one pass with map-side combining, so a group of
    any size costs one small record per task.
    """
    vector = array_to_vector(F.col(features))
    stats = df.groupBy(*(by or [])).agg(
        Summarizer.metrics("count", "mean", "variance").summary(vector).alias("s")
    )
    share = (F.col("s.count") - 1) / F.col("s.count")
    return (
        stats.select(
            *(by or []),
            share.alias("share"),
            F.posexplode(
                F.arrays_zip(
                    vector_to_array(F.col("s.mean")).alias("mean"),
                    vector_to_array(F.col("s.variance")).alias("variance"),
                )
            ).alias("pos", "m"),
        )
        .select(
            *(by or []),
            "pos",
            F.col("m.mean").alias("mean"),
            F.sqrt(F.when(F.col("share") > 0, F.col("m.variance") * F.col("share")).otherwise(0.0)).alias("std"),
        )
    )


def standardise(features: Column | str, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std per position; a constant position keeps x - mean."""
    means = F.lit(np.asarray(mean, dtype="float64"))
    scales = F.lit(np.asarray([s if s else 1.0 for s in std], dtype="float64"))
    centred = F.zip_with(features, means, lambda x, m: x - m)
    return F.zip_with(centred, scales, lambda x, s: x / s)


class PopulationScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the mean and population deviation of each position of an array column."""

    @keyword_only
    def __init__(self, *, inputCol: str = "spectrum", outputCol: str = "scaled"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="spectrum", outputCol="scaled")

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        vector = array_to_vector(F.col(self.getInputCol()))
        row = dataset.agg(Summarizer.metrics("count", "mean", "variance").summary(vector).alias("s")).head().s
        n = row["count"]
        std = np.sqrt(row["variance"].toArray() * (n - 1) / n) if n > 1 else np.zeros(row["mean"].size)
        return PopulationScalerModel(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            mean=row["mean"].toArray().tolist(),
            std=std.tolist(),
        )


class PopulationScalerModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    mean = Param(Params._dummy(), "mean", "mean per position", TypeConverters.toListFloat)
    std = Param(Params._dummy(), "std", "population deviation per position", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = "spectrum",
        outputCol: str = "scaled",
        mean: list[float] | None = None,
        std: list[float] | None = None,
    ):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(inputCol="spectrum", outputCol="scaled")

    def statistics(self) -> list[tuple[int, float, float]]:
        return [(i, m, s) for i, (m, s) in enumerate(zip(self.getOrDefault("mean"), self.getOrDefault("std")))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = standardise(self.getInputCol(), self.getOrDefault("mean"), self.getOrDefault("std"))
        return dataset.withColumn(self.getOutputCol(), scaled)
