"""Scaling, partial least squares, neighbours, oversampling and back-projection."""

import decimal
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lumiframe.functions.sizes import cut_lineage
from lumiframe.operators.backproject import back_project, band_series
from lumiframe.operators.neighbours import _closest, _Pivots, _Points, _together, nearest_in_class, squared_distances
from lumiframe.operators.pls import PLS, components
from lumiframe.operators.scale import PopulationScaler, column_statistics
from lumiframe.operators.smote import draws, lerp, smote, synthetic_rows
from lumiframe.plans.prepare import Preparation, prepare


def frame(spark, x, y):
    rows = [(i, int(c), [float(v) for v in row]) for i, (row, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, code int, spectrum array<double>").repartition(5)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 120)
    x = rng.normal(size=(120, 12)) + 1000 + y[:, None] * rng.normal(size=12)
    return x, y


def deflated(x, y, k):
    """Row-deflating partial least squares with one response."""
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = (y - y.mean()) / y.std(ddof=1)
    first, weights, scores = x, [], []
    for _ in range(k):
        w = x.T @ y
        w /= np.linalg.norm(w)
        w = w if w[np.argmax(np.abs(w))] > 0 else -w
        t = x @ w
        p = x.T @ t / (t @ t)
        y = y - t * (t @ y) / (t @ t)
        x = x - np.outer(t, p)
        weights.append(w)
        scores.append(t)
    assert first.shape == x.shape
    return np.column_stack(weights), np.column_stack(scores)


@pytest.mark.parametrize("max_gram", [100, 2])
def test_pls_equals_row_deflation(spark, sample, max_gram):
    x, y = sample
    df = frame(spark, x, y)
    model = PLS(k=4, maxGram=max_gram).fit(df)
    weights, scores = deflated(x, y, 4)
    assert np.allclose(model.weight_matrix(), weights, atol=1e-8)
    found = np.array([r["scores"] for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(found, scores, atol=1e-7)
    products = found.T @ found
    assert np.allclose(products, np.diag(products.diagonal()), atol=1e-6)
    assert np.allclose(model.weight_matrix().T @ model.weight_matrix(), np.eye(4), atol=1e-8)


def test_scaling_in_front_changes_no_score(spark, sample):
    df = frame(spark, *sample)
    plain = PLS(k=3).fit(df).transform(df).orderBy("id").collect()
    scaled = PopulationScaler(inputCol="spectrum", outputCol="scaled").fit(df).transform(df)
    after = PLS(inputCol="scaled", k=3).fit(scaled).transform(scaled).orderBy("id").collect()
    assert np.allclose([r["scores"] for r in plain], [r["scores"] for r in after], atol=1e-8)


@pytest.mark.parametrize("max_gram", [100, 2])
def test_one_response_a_class(spark, sample, max_gram):
    x, y = sample
    codes = np.arange(len(y)) % 3 + 0.0
    x = x + 0.7 * np.outer(codes == 1, np.arange(x.shape[1])) + 0.9 * np.outer(codes == 2, np.arange(x.shape[1])[::-1])
    model = PLS(k=4, maxGram=max_gram, oneHot=True).fit(frame(spark, x, codes))
    # Deflation of the rows themselves, with the leading singular vector of X'Y at each step.
    e = (x - x.mean(0)) / x.std(0, ddof=1)
    hot = (codes[:, None] == np.arange(3)).astype(float)
    f = (hot - hot.mean(0)) / hot.std(0, ddof=1)
    for a in range(4):
        w = np.linalg.svd(e.T @ f)[0][:, 0]
        w = w if w[np.argmax(np.abs(w))] > 0 else -w
        assert np.allclose(model.weight_matrix()[:, a], w, atol=1e-8)
        t = e @ w
        e, f = e - np.outer(t, t @ e) / (t @ t), f - np.outer(t, t @ f) / (t @ t)
    turned = PLS(k=4, maxGram=max_gram, oneHot=True).fit(frame(spark, x, (codes + 1) % 3))
    assert np.allclose(turned.weight_matrix(), model.weight_matrix(), atol=1e-9)  # the order of the classes has no effect
    single = [PLS(k=2, maxGram=max_gram).fit(frame(spark, x, c)).weight_matrix() for c in (codes, (codes + 1) % 3)]
    assert not np.allclose(*single, atol=1e-3)


def test_pls_of_many_independent_rows():
    """X'X close to a multiple of 1, as it is of many rows: X'y shrinks 50 times and more with each component."""
    rng = np.random.default_rng(5)
    p, k = 24, 10
    turn = np.linalg.qr(rng.normal(size=(p, p)))[0]
    gram = turn @ np.diag(1 + 0.01 * np.linspace(-1, 1, p)) @ turn.T
    s = turn @ rng.uniform(0.5, 1, p)
    weights, rotations = components(s, lambda v: gram @ v, k)
    # The same basis in numbers of 80 digits.
    with decimal.localcontext(prec=80):
        exact, g, basis = (np.vectorize(decimal.Decimal, otypes=[object])(x) for x in (s, gram, np.empty((0, p))))
        for _ in range(k):
            exact = exact - basis.T @ (basis @ exact)
            basis = np.vstack([basis, exact / (exact @ exact).sqrt()])
            exact = g @ basis[-1]
    found = basis.astype(float).T
    found *= np.sign(found[np.abs(found).argmax(0), range(k)])
    assert np.allclose(weights, found, atol=1e-9)
    scores = rotations.T @ gram @ rotations
    assert np.allclose(scores, np.diag(scores.diagonal()), atol=1e-9)


def test_pls_errors(spark, sample):
    x, y = sample
    with pytest.raises(ValueError, match="used up"):
        PLS(k=2).fit(frame(spark, x, np.ones(120)))
    with pytest.raises(ValueError, match="between 1 and 12"):
        PLS(k=13).fit(frame(spark, x, y))


def test_scaler(spark, sample):
    x, y = sample
    x = np.column_stack([x, np.full(120, 5.0)])
    df = frame(spark, x, y)
    out = PopulationScaler().fit(df).transform(df)
    z = np.array([r["scaled"] for r in out.orderBy("id").collect()])
    assert np.allclose(z[:, :-1].mean(0), 0, atol=1e-9) and np.allclose(z[:, :-1].std(0), 1)
    assert (z[:, -1] == 0).all()
    model = PopulationScaler().fit(df)
    moved = model.transform(spark.createDataFrame([([float(v) for v in x[0][:-1]] + [7.0],)], "spectrum array<double>"))
    assert moved.head()["scaled"][-1] == 2.0
    stats = column_statistics(df, "spectrum").orderBy("pos").collect()
    assert np.allclose([r["std"] for r in stats], x.std(0), atol=1e-9)


def brute(points, k):
    out = {}
    for i, c, v in points:
        others = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, d, w in points if d == c and j != i)
        out[i] = [j for _, j in others[:k]]
    return out


def found_neighbours(df, k, **layout):
    out = {}
    for r in nearest_in_class(df, "id", "spectrum", "code", k, **layout).collect():
        out.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    return {i: [near[n] for n in sorted(near)] for i, near in out.items()}


@pytest.mark.parametrize(
    "layout",
    [{}, {"cell_rows": 20, "block_rows": 1000}, {"cell_rows": 1000, "block_rows": 16}, {"cell_rows": 15, "block_rows": 7}],
)
def test_neighbours_equal_brute_force(spark, layout):
    rng = np.random.default_rng(1)
    # A third of the rows are copies of one point, many distances are equal, two points lie far out.
    points = [(i, int(i % 2), [1.0, 2.0, 3.0] if i % 3 == 0 else [float(v) for v in rng.integers(0, 6, 3)]) for i in range(240)]
    points += [(240, 0, [500.0, 500.0, 500.0]), (241, 1, [-900.0, 0.0, 3.5])]
    df = spark.createDataFrame(points, "id long, code int, spectrum array<double>").repartition(4)
    assert found_neighbours(df, 5, **layout) == brute(points, 5)


@pytest.mark.parametrize("width, far", [(2, 0.0), (12, 1e6)])
def test_neighbours_of_many_small_tiles(spark, width, far):
    """Few rows a tile, points far from the origin: every base goes to several tiles, a visited tile is copied."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, width)), 1) + far
    points = [(i, int(i % 3 == 0), row.tolist()) for i, row in enumerate(x)]
    df = spark.createDataFrame(points, "id long, code int, spectrum array<double>").repartition(4)
    assert found_neighbours(df, 5, cell_rows=12, block_rows=8, tile_rows=20) == brute(points, 5)


def test_tasks_of_the_neighbour_search_are_bounded():
    """Tiles hold a bounded number of rows whatever the cells, and a base is listed once a tile and not once a block."""
    rng = np.random.default_rng(8)
    pivots = _Pivots({0: rng.normal(size=(100, 4))})
    sizes = rng.integers(1, 60, 100)
    table = pivots.describe([(0, c, int(n), 9.0) for c, n in enumerate(sizes)], 25, 500)
    assert sum(n for _, _, _, n, _ in table) == sizes.sum() and {blocks for _, _, blocks, _, _ in table} == {1, 2, 3}
    assert len(pivots.cells[0]) == -(-sizes.sum() // 500)
    assert max(sizes[held].sum() for _, held in pivots.cells[0]) <= 500 + 2 * 60
    bases = rng.normal(size=(40, 4))
    lists = [len(reach) for _, _, reach in pivots.visits(0, bases, np.full(40, np.inf), 6)]
    assert sum(lists) == 40


def test_bases_that_visit_much_the_same_cells_go_together():
    rows, cell = np.array([10, 10, 10, 10]), np.array([5, 5, 7, 7, 7, 8])
    full = np.ones((6, 4), dtype=bool)
    assert [s for s, _ in _together(full, rows, cell)] == [slice(0, 6)]
    apart = np.array([[1, 0, 0, 0]] * 2 + [[0, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 0]] + [[0, 0, 0, 1]], dtype=bool)
    found = [(s, u.tolist()) for s, u in _together(apart, rows, cell)]
    assert [s for s, _ in found] == [slice(0, 2), slice(2, 5), slice(5, 6)] and found[1][1] == [False, True, True, False]


def test_closest_equals_all_distances():
    rng = np.random.default_rng(9)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e5), (1e160, 0.0)):
        a, b = (np.round(rng.normal(size=(n, 3)), 2) * scale + shift for n in (70, 400))
        with np.errstate(over="ignore"):
            d2 = squared_distances(a, b)
            found = _closest(a, b, 4)
            assert all(np.array_equal(x, y) for x, y in zip(found, _closest(a, _Points(b, b[0]), 4)))
        expected = np.argsort(d2, axis=1, kind="stable")[:, :4]
        assert (found[1].reshape(-1, 4) == expected).all() and (found[2].reshape(-1, 4) == np.take_along_axis(d2, expected, 1)).all()
        limit = np.sort(d2, axis=1)[:, 1]
        base, near, _ = _closest(a, b, 4, limit)
        assert set(zip(*np.nonzero(d2 <= limit[:, None]))) & set(zip(np.repeat(np.arange(70), 4), expected.ravel())) <= set(zip(base, near))


def test_neighbours_of_chosen_bases_with_text_keys(spark):
    rng = np.random.default_rng(2)
    points = [(f"k{i:03d}", 0, [float(v) for v in rng.normal(size=4)]) for i in range(150)]
    df = spark.createDataFrame(points, "id string, code int, spectrum array<double>")
    bases = df.where("id < 'k020'").select("code", "id")
    near = found_neighbours(df, 3, bases=bases, cell_rows=20, block_rows=10)
    assert near == {i: n for i, n in brute(points, 3).items() if i < "k020"}


def test_class_smaller_than_k(spark):
    points = [(i, 0, [float(i)]) for i in range(3)]
    df = spark.createDataFrame(points, "id long, code int, spectrum array<double>")
    assert found_neighbours(df, 5) == brute(points, 5)


def test_smote_balances_between_neighbours(spark):
    rng = np.random.default_rng(3)
    points = [(i, 0 if i < 60 else 1 if i < 80 else 2, [float(v) for v in rng.normal(size=3)]) for i in range(90)]
    df = spark.createDataFrame(points, "id long, code int, spectrum array<double>")
    near = brute(points, 5)
    by_id = {i: np.array(v) for i, _, v in points}
    rows = synthetic_rows(df, "id", "spectrum", "code").collect()
    assert {c: sum(1 for r in rows if r["code"] == c) for c in (1, 2)} == {1: 40, 2: 50}
    for r in rows:
        assert r["neighbour"] in near[r["base"]] and 0 <= r["u"] < 1
        a, b = by_id[r["base"]], by_id[r["neighbour"]]
        assert np.allclose(r["spectrum"], a + r["u"] * (b - a))
    every = smote(df, "id", "spectrum", "code")
    assert dict(every.groupBy("code").count().collect()) == {0: 60, 1: 60, 2: 60}
    assert every.select("id").distinct().count() == 180


def test_smote_needs_more_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, int(i > 20), [float(i)]) for i in range(26)], "id long, code int, spectrum array<double>")
    with pytest.raises(ValueError, match="more than 5"):
        smote(df, "id", "spectrum", "code")
    same = spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(6)], "id long, code int, spectrum array<double>")
    assert smote(same, "id", "spectrum", "code").count() == 6


def test_lerp(spark):
    df = spark.createDataFrame([([0.0, 2.0], [4.0, 2.0], 0.25)], "a array<double>, b array<double>, u double")
    assert df.select(lerp("a", "b", "u")).head()[0] == [1.0, 2.0]


def test_back_projection(spark):
    weights = np.array([[0.6, 0.0], [0.0, 1.0], [0.8, 0.0]])
    table = spark.createDataFrame(
        [(a, j, float(weights[j, a])) for a in range(2) for j in range(3)], "component int, pos int, weight double"
    )
    importance = spark.createDataFrame([(0, 0.5), (1, -0.3)], "component int, importance double")
    axis = spark.createDataFrame([(0, 1849.9), (1, 1850.0), (2, 2500.5)], "pos int, wavenumber double")
    rows = back_project(importance, table, axis).orderBy("rank").collect()
    assert [r["wavenumber"] for r in rows] == [2500.5, 1849.9]
    assert [r["importance"] for r in rows] == pytest.approx([0.4, 0.3])
    bands = [(r["wavenumber"], r["band"]) for r in band_series(axis).collect()]
    assert bands == [(2500.5, "high"), (1849.9, "low")]


def test_prepare_and_stored_chain(spark, sample, tmp_path):
    df = frame(spark, *sample)
    ready = prepare(df, Preparation(train_percentage=0.75, n_components=3))
    sizes = dict(ready.train.groupBy("code").count().collect())
    assert len(set(sizes.values())) == 1 and ready.test.count() == 30 and ready.n_features == 3
    path = str(tmp_path / "chain")
    ready.model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(df).select("id", "features").orderBy("id").collect()
    assert again == ready.model.transform(df).select("id", "features").orderBy("id").collect()
    whole = prepare(df, Preparation(train_percentage=1, apply_pls=False, apply_smote_resampling=False))
    assert whole.train.count() == 120 and whole.test.count() == 0 and whole.weights is None
    unscaled = prepare(df, Preparation(apply_pls=False, scale=False, apply_smote_resampling=False))
    row = unscaled.train.where("id = '0'").union(unscaled.test.where("id = '0'")).head()
    assert list(row["features"]) == pytest.approx(list(sample[0][0]))
    assert df.where(F.size("spectrum") != 12).count() == 0


def test_draws_of_a_large_class_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("lumiframe.operators.smote.DRAWS", 10)
    df = spark.range(120).select("id", (F.col("id") < 10).cast("int").alias("code"))
    drawn = draws(df, "code", 5, 52)
    assert drawn.rdd.getNumPartitions() == 10
    assert sorted((r["code"], r["j"]) for r in drawn.collect()) == [(1, j) for j in range(100)]


def test_draws_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    """Two classes become thousands of draws: their size as Spark guesses it says nothing."""
    path = f"file://{tmp_path}/points"
    code = F.when(F.col("id") < 40, 0).otherwise(1).alias("code")
    spark.range(4000).select("id", code, F.array(F.sqrt("id"), F.sin("id")).alias("spectrum")).write.parquet(path)
    plans = []

    def kept(df, *rest):
        if "base_no" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df, *rest)

    monkeypatch.setattr("lumiframe.operators.smote.cut_lineage", kept)
    made = synthetic_rows(spark.read.parquet(path), "id", "spectrum", "code", k=3)
    assert made.count() == 3920 and made.where("neighbour >= 40").count() == 0
    assert [re.findall(r"\w+Join", p)[0] for p in plans] == ["SortMergeJoin"]
