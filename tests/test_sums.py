"""Fits from merged sums equal fits from all rows."""

import numpy as np
import pytest

from lumiframe.operators.pls import PLS
from lumiframe.operators.scale import PopulationScaler
from lumiframe.operators.sums import Sums


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12)) + 1000 * rng.normal(size=12)
    x[:, 5] = 7.25  # a constant position
    y = (x[:, 0] > np.median(x[:, 0])).astype(int) + (x[:, 1] > x[:, 1].mean())
    data = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, spectrum array<double>, code int").cache()


def values(model, *names):
    return [np.array(model.getOrDefault(n)) for n in names]


def test_merged_fits_equal_fits_from_scratch(spark, rows, tmp_path):
    path = f"file://{tmp_path}/sums"
    for part in ("id < 20", "id >= 20 and id < 90", "id >= 90"):
        Sums.of(rows.where(part)).save(spark, path, part.replace(" ", "_"))
    Sums.of(rows.where("id < 20")).save(spark, path, "id_<_20")  # saved again, counted once
    merged = Sums.load(spark, path)
    assert merged.rows == 150
    found, expected = merged.pls(4), PLS(k=4).fit(rows)
    for a, b in zip(values(found, "mean", "scale", "weights", "rotations"), values(expected, "mean", "scale", "weights", "rotations")):
        assert np.abs(a - b).max() <= 1e-9 * max(1, np.abs(b).max())
    scaler, plain = merged.scaler(), PopulationScaler().fit(rows)
    for a, b in zip(values(scaler, "mean", "std"), values(plain, "mean", "std")):
        assert np.abs(a - b).max() <= 1e-9 * max(1, np.abs(b).max())
    assert values(scaler, "std")[0][5] == 0
    scores = found.transform(rows).select("scores").head()[0]
    assert np.allclose(scores, expected.transform(rows).select("scores").head()[0], rtol=1e-8, atol=1e-8)


def test_refused_sums(spark, rows, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        Sums.of(rows.limit(0))
    short = rows.selectExpr("slice(spectrum, 1, 3) as spectrum", "code")
    with pytest.raises(ValueError, match="axes differ"):
        Sums.of(rows) + Sums.of(short)
    with pytest.raises(ValueError, match="between 1 and 3"):
        Sums.of(short).pls(4)
