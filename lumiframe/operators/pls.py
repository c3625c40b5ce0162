"""Partial least squares with one response, fitted from one pass over the rows.

The rows leave the executors only as sums of products. The components are then
a short recursion on those sums (improved kernel PLS, Dayal & MacGregor 1997).
For axes too long for a p x p matrix, each component reads the rows twice
instead and moves vectors of length p only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_COMPONENTS

MAX_GRAM_POSITIONS = 8192


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column as an (n, p) matrix; every list must have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype("float64", copy=False) if len(column) else np.empty((0, 0))


def _add_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum the partial vectors of equal number; the result has a bounded size."""
    total = parts.groupBy("pos").agg(Summarizer.sum(array_to_vector("part")).alias("total"))
    return {r["pos"]: r["total"].toArray() for r in total.collect()}


def cross_products(df: DataFrame, features: str, label: str, classes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A'A for A = [1, x - c, y], with c the first row; also returns c.

    With ``classes`` the label is a code and y has a column for each class, one where the code is that class.

    Shifting by any row keeps the later centring free of cancellation. Each task
    multiplies its batches with BLAS and emits one matrix.
    """
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"))
    shift = np.asarray(rows.head().x, dtype="float64")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(0)) - shift
            y = batch.column(1).to_numpy(zero_copy_only=False)
            a = np.column_stack([np.ones(len(y)), x, y if classes is None else y[:, None] == np.arange(classes)])
            total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            for i in range(len(total)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([total[i]], pa.list_(pa.float64()))], ["pos", "part"]
                )

    # One matrix per task; the sum by position combines those of one executor's tasks before they move.
    parts = rows.mapInArrow(partial, "pos int, part array<double>")
    summed = _add_up(parts)
    return np.vstack([summed[i] for i in range(len(summed))]), shift


def _rows_product(df: DataFrame, mean: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over rows of weight(x, y) * x for centred x, in one pass that moves vectors of length p."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(0)) - mean
            part = weight(x, batch.column(1).to_numpy(zero_copy_only=False)) @ x
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["pos", "part"]
            )

    return _add_up(df.mapInArrow(partial, "pos int, part array<double>"))[0]


def components(
    s: np.ndarray, gram_times: Callable[[np.ndarray], np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights W and rotations R (both p x k) from X'y and the product r -> X'X r.

    With one response the weights are an orthonormal basis of s, Gs, GGs, ... for G = X'X,
    so the next one is what G makes of the last one beside those before it. Taking it
    off the deflated ``s`` instead loses digits with each component: the more rows, the
    closer G of independent positions is to a multiple of 1 and the faster ``s`` shrinks.

    With several responses ``s`` is X'Y; the weight of a component is then its
    leading left singular vector, the direction that covaries most with all of them.
    """
    weights, rotations, loadings, images = [], [], [], []
    s = s.reshape(len(s), -1)
    single, scale = s.shape[1] == 1, np.linalg.norm(s)
    for a in range(k):
        norm = np.linalg.norm(s)
        if norm <= 1e-12 * scale or norm == 0:
            raise ValueError(f"the response is used up after {a} components")
        w = s[:, 0] / norm if single else np.linalg.svd(s, full_matrices=False)[0][:, 0]
        w = w if w[np.argmax(np.abs(w))] > 0 else -w
        r, gw = w.copy(), gram_times(w)
        gr = gw.copy()
        for p_j, r_j, gr_j in zip(loadings, rotations, images):
            share = p_j @ w
            r -= share * r_j
            gr -= share * gr_j
        p = gr / (r @ gr)
        weights.append(w)
        rotations.append(r)
        loadings.append(p)
        images.append(gr)
        if single:
            s, scale = gw[:, None], np.linalg.norm(gw)
            for _ in range(2):  # once leaves rounding errors along the weights
                for w_j in weights:
                    s = s - np.outer(w_j, w_j @ s)
        else:
            s = s - np.outer(p, r @ s)
    return np.column_stack(weights), np.column_stack(rotations)


class PLS(Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Projection of an array column on ``k`` components that follow an integer label.

    With ``oneHot`` the response has a column for each code from 0 to the largest,
    so the order of the classes does not shape the components. There are then as
    many components as covariance is left for, at most the length of the axis.
    """

    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)
    maxGram = Param(Params._dummy(), "maxGram", "longest axis whose p x p matrix is formed", TypeConverters.toInt)

    oneHot = Param(Params._dummy(), "oneHot", "a response for each class", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = "spectrum",
        outputCol: str = "scores",
        labelCol: str = "code",
        k: int = DEFAULT_COMPONENTS,
        maxGram: int = MAX_GRAM_POSITIONS,
        oneHot: bool = False,
    ):
        super().__init__()
        self._setDefault(inputCol="spectrum", outputCol="scores", labelCol="code", k=DEFAULT_COMPONENTS)
        self._setDefault(maxGram=MAX_GRAM_POSITIONS, oneHot=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PLSModel:
        features, label, k = self.getInputCol(), self.getLabelCol(), self.getOrDefault("k")
        first = dataset.select(features).head()
        if first is None:
            raise ValueError("no rows to fit")
        width = len(first[0])
        if not 1 <= k <= width:
            raise ValueError(f"k must be between 1 and {width}")
        classes = int(dataset.agg(F.max(label)).head()[0]) + 1 if self.getOrDefault("oneHot") else None
        if width <= self.getOrDefault("maxGram"):
            mean, scale, weights, rotations = self._from_gram(dataset, features, label, k, classes)
        else:
            mean, scale, weights, rotations = self._from_passes(dataset, features, label, k, classes)
        return self._model(mean, scale, weights, rotations)

    def fit_sums(self, sums: np.ndarray, shift: np.ndarray) -> PLSModel:
        """The model of the rows that ``sums`` and ``shift`` of ``cross_products`` stand for, without reading them."""
        k, width = self.getOrDefault("k"), len(shift)
        if not 1 <= k <= width:
            raise ValueError(f"k must be between 1 and {width}")
        return self._model(*self._from_sums(sums, shift, k))

    def _model(self, mean, scale, weights, rotations) -> PLSModel:
        return PLSModel(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            mean=mean.tolist(),
            scale=scale.tolist(),
            weights=weights.ravel().tolist(),
            rotations=rotations.ravel().tolist(),
            k=self.getOrDefault("k"),
        )

    @classmethod
    def _from_gram(cls, dataset, features, label, k, classes=None):
        return cls._from_sums(*cross_products(dataset, features, label, classes), k)

    @staticmethod
    def _from_sums(sums, shift, k):
        n = sums[0, 0]
        middle = sums[0, 1:] / n
        centred = sums[1:, 1:] - n * np.outer(middle, middle)
        var = np.clip(np.diag(centred), 0, None) / (n - 1)
        floor = np.finfo(float).eps * np.abs(sums.diagonal()[1:]) / n
        std = np.sqrt(np.where(var <= floor, 0.0, var))
        std[std == 0] = 1.0
        scaled = centred / np.outer(std, std)
        p = len(shift)
        gram, s = scaled[:p, :p], scaled[:p, p:]
        weights, rotations = components(s, lambda r: gram @ r, k)
        return shift + middle[:p], std[:p], weights, rotations

    @staticmethod
    def _from_passes(dataset, features, label, k, classes=None):
        rows = dataset.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"))
        stats = rows.agg(
            Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("x"),
            F.avg("y").alias("y"),
            F.stddev_samp("y").alias("y_std"),
        ).head()
        mean, std = stats.x["mean"].toArray(), stats.x["std"].toArray()
        std[std == 0] = 1.0
        if classes is None:
            responses = [(None, stats.y, stats.y_std or 1.0)]
        else:
            shares = [F.avg((F.col("y") == c).cast("double")) for c in range(classes)]
            spreads = [F.stddev_samp((F.col("y") == c).cast("double")) for c in range(classes)]
            found = rows.agg(*shares, *spreads).head()
            responses = [(c, found[c], found[classes + c] or 1.0) for c in range(classes)]

        def gram_times(r):
            return _rows_product(rows, mean, lambda x, y: (x / std) @ r) / std

        def covariance(code, y_mean, y_std):
            return _rows_product(rows, mean, lambda x, y: ((y if code is None else y == code) - y_mean) / y_std) / std

        s = np.column_stack([covariance(*r) for r in responses])
        weights, rotations = components(s, gram_times, k)
        return mean, std, weights, rotations


class PLSModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)
    mean = Param(Params._dummy(), "mean", "mean per position", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "sample deviation per position", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "weights, row-major p x k", TypeConverters.toListFloat)
    rotations = Param(Params._dummy(), "rotations", "rotations, row-major p x k", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = "spectrum",
        outputCol: str = "scores",
        k: int = DEFAULT_COMPONENTS,
        mean: list[float] | None = None,
        scale: list[float] | None = None,
        weights: list[float] | None = None,
        rotations: list[float] | None = None,
    ):
        super().__init__()
        self._setDefault(inputCol="spectrum", outputCol="scores", k=DEFAULT_COMPONENTS)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def weight_matrix(self) -> np.ndarray:
        return np.asarray(self.getOrDefault("weights")).reshape(-1, self.getOrDefault("k"))

    def weight_rows(self) -> list[tuple[int, int, float]]:
        matrix = self.weight_matrix()
        p, k = matrix.shape
        return [(a, j, float(matrix[j, a])) for a in range(k) for j in range(p)]

    def weights_table(self, spark: SparkSession) -> DataFrame:
        """(component, pos, weight): p x k rows, whatever the number of samples."""
        return spark.createDataFrame(self.weight_rows(), "component int, pos int, weight double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean, scale = np.asarray(self.getOrDefault("mean")), np.asarray(self.getOrDefault("scale"))
        turn = np.asarray(self.getOrDefault("rotations")).reshape(-1, self.getOrDefault("k")) / scale[:, None]

        @F.arrow_udf("array<double>")
        def project(column: pa.Array) -> pa.Array:
            scores = (rows_of(column) - mean) @ turn if len(column) else np.empty((0, turn.shape[1]))
            offsets = np.arange(0, scores.size + 1, turn.shape[1], dtype="int32")
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()))

        return dataset.withColumn(self.getOutputCol(), project(F.col(self.getInputCol())))
