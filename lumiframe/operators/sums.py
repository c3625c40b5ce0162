"""Sums of products that are stored, merged and fitted from."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .pls import PLS, PLSModel, cross_products
from .scale import PopulationScalerModel

SCHEMA = "part string, pos int, shift double, products array<double>"


@dataclass(frozen=True)
class Sums:
    """A'A of the rows A = [1, x - shift, y]; all that the scaler and the projection need of them.

    Sums of other rows can be added later, so a new partition of a table extends a
    fit without a read of the old ones. The size is that of the axis squared,
    whatever the number of rows.
    """

    products: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, features: str = "spectrum", label: str = "code") -> Sums:
        """Sums of the rows of ``df``, which must have one at least, in one pass."""
        if not df.take(1):
            raise ValueError("no rows to add up")
        return cls(*cross_products(df, features, label))

    @property
    def rows(self) -> int:
        return round(self.products[0, 0])

    def __add__(self, other: Sums) -> Sums:
        """Sums of both sets of rows, at the shift of the first."""
        if len(self.shift) != len(other.shift):
            raise ValueError("the axes differ in length")
        move = np.eye(len(self.products))
        move[0, 1:-1] = other.shift - self.shift
        return Sums(self.products + move.T @ other.products @ move, self.shift)

    def save(self, spark: SparkSession, path: str, part: str | None = None) -> None:
        """Add one part to the table of sums under ``path``; a part that is saved again replaces itself."""
        shifts = [None, *self.shift.tolist(), None]
        rows = [(i, s, row.tolist()) for i, (s, row) in enumerate(zip(shifts, self.products))]
        table = spark.createDataFrame(rows, SCHEMA.split(", ", 1)[1])
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part or uuid.uuid4().hex}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Sums:
        """The sum of all parts of a table, read part by part in the order of their names."""
        rows = spark.read.schema(SCHEMA).parquet(path).orderBy("part", "pos")
        total, name, held = None, None, []
        for r in [*rows.toLocalIterator(), None]:
            if held and (r is None or r["part"] != name):
                own = cls(np.array([h["products"] for h in held]), np.array([h["shift"] for h in held[1:-1]]))
                total, held = own if total is None else total + own, []
            if r is not None:
                name = r["part"]
                held.append(r)
        if total is None:
            raise ValueError("no sums are stored")
        return total

    def scaler(self, features: str = "spectrum", out: str = "scaled") -> PopulationScalerModel:
        """The standardiser of the rows behind these sums."""
        n = self.products[0, 0]
        middle = self.products[0, 1:-1] / n
        squares = np.diag(self.products)[1:-1] / n
        var = squares - middle**2
        var = np.where(var <= np.finfo(float).eps * squares, 0.0, var)  # what rounding leaves of a constant position
        return PopulationScalerModel(inputCol=features, outputCol=out, mean=(self.shift + middle).tolist(), std=np.sqrt(var).tolist())

    def pls(self, k: int, features: str = "spectrum", out: str = "scores") -> PLSModel:
        """The projection of the rows behind these sums on ``k`` components."""
        return PLS(inputCol=features, outputCol=out, k=k).fit_sums(self.products, self.shift)
