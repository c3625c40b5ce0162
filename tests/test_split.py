"""Split and fold sizes, and order operators against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumiframe.operators import ordering
from lumiframe.operators.encode import decode, encode
from lumiframe.operators import split
from lumiframe.operators.select import select_samples
from lumiframe.operators.split import stratified_folds, stratified_split

# Recorded test rows per class for the training shares 0.8, 0.7 and 0.6.
RECORDED = {0.8: (9, 20, 11), 0.7: (13, 30, 17), 0.6: (17, 39, 23)}


def allocate(counts, draws):
    total = sum(counts.values())
    exact = {c: n / total * draws for c, n in counts.items()}
    share = {c: math.floor(x) for c, x in exact.items()}
    order = sorted(counts, key=lambda c: (-(exact[c] - share[c]), c))
    for c in order[: draws - sum(share.values())]:
        share[c] += 1
    return share


def train_sizes(counts, fraction):
    total = sum(counts.values())
    return allocate(counts, total - math.ceil((1 - fraction) * total))


def fold_sizes(counts, k):
    sizes, start = {}, 0
    for c, n in sorted(counts.items()):
        sizes[c] = [len(range((i - start) % k, n, k)) for i in range(k)]
        start += n
    return sizes


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "c int, n long")


def test_recorded_test_sizes():
    """One set of class totals with 197 rows fits all three recorded vectors, up to equal remainders."""
    fitting = []
    for a in range(35, 55):
        for b in range(85, 110):
            c = 197 - a - b
            counts = {0: a, 1: b, 2: c}
            sizes = {f: tuple(counts[k] - n for k, n in train_sizes(counts, f).items()) for f in RECORDED}
            if sizes == RECORDED:
                fitting.append((a, b, c))
    assert fitting


def test_bounds_of_the_share(spark):
    for counts, share in (({0: 5, 1: 5}, 0), ({0: 5, 1: 5}, 1.2), ({0: 5, 1: 1}, 0.5)):
        with pytest.raises(ValueError):
            split.train_sizes(counted(spark, counts), "c", share)
    assert {r["c"]: r["size"] for r in split.train_sizes(counted(spark, {0: 5, 1: 1}), "c", 1).collect()} == {0: 5, 1: 1}


def test_allocation(spark):
    rng = random.Random(1)
    for _ in range(5):
        counts = {i: rng.randint(1, 50) for i in range(rng.randint(2, 40))}
        draws = rng.randint(0, sum(counts.values()))
        share = {r["c"]: r["size"] for r in split.allocate(counted(spark, counts), "c", draws).collect()}
        assert share == allocate(counts, draws)
        assert sum(share.values()) == draws and all(0 <= share[c] <= counts[c] for c in counts)


def test_thousands_of_classes(spark):
    """One class a key: split, folds and sizes take the same path as three classes."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(3000)) for i in range(20000)]
    counts = {}
    for _, c in rows:
        counts[c] = counts.get(c, 0) + 1
    rows = [r for r in rows if counts[r[1]] > 1]
    counts = {c: n for c, n in counts.items() if n > 1}
    df = spark.createDataFrame(rows, "id long, c int")
    found = {r["c"]: r["n"] for r in stratified_split(df, "id", "c", 0.7).where("is_train").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert found == {c: n for c, n in train_sizes(counts, 0.7).items() if n}
    sizes = fold_sizes(counts, 5)
    folds = stratified_folds(df, "id", "c", 5, 1).groupBy("c", "fold").count().collect()
    assert {(r["c"], r["fold"]): r["count"] for r in folds} == {(c, f): n for c, s in sizes.items() for f, n in enumerate(s) if n}


def test_error_names_the_real_fault(spark):
    """A type among very many that has no value is not reported as an unknown one."""
    df = spark.createDataFrame([(f"t{i:05d}", [1.0], None if i == 2999 else "x") for i in range(3000)], "sample_type string, spectrum array<double>, target string")
    with pytest.raises(ValueError, match="no value"):
        select_samples(df, "target", "t02999")
    with pytest.raises(ValueError, match="no sample type.*and more"):
        select_samples(df, "target", "unknown")


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 700, "x").when(F.col("id") < 950, "y").otherwise("z"))
    first = stratified_split(df, "id", "c", 0.7).where("is_train").select("id").collect()
    again = stratified_split(df.repartition(7), "id", "c", 0.7).where("is_train").select("id").collect()
    assert {r[0] for r in first} == {r[0] for r in again}
    sizes = train_sizes({"x": 700, "y": 250, "z": 50}, 0.7)
    found = dict(stratified_split(df, "id", "c", 0.7).where("is_train").groupBy("c").count().collect())
    assert found == sizes
    other = {r[0] for r in stratified_split(df, "id", "c", 0.7, seed=1).where("is_train").select("id").collect()}
    assert other != {r[0] for r in first}


@pytest.mark.parametrize("seed", [None, 4])
def test_folds(spark, seed):
    counts = {0: 13, 1: 40, 2: 3}
    rows = [(i * 3, c) for i, c in enumerate([0] * 13 + [1] * 40 + [2] * 3)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, c int")
    folds = stratified_folds(df, "id", "c", 5, seed).collect()
    sizes = fold_sizes(counts, 5)
    for c, per_fold in sizes.items():
        assert [sum(1 for r in folds if r["c"] == c and r["fold"] == f) for f in range(5)] == per_fold
    totals = [sum(1 for r in folds if r["fold"] == f) for f in range(5)]
    assert max(totals) - min(totals) <= 1
    if seed is None:
        ordered = [r["fold"] for r in sorted(folds, key=lambda r: r["id"]) if r["c"] == 1]
        assert ordered == sorted(ordered)


def test_class_without_rows_in_the_first_folds(spark):
    counts = {0: 6, 1: 2}
    df = spark.createDataFrame([(i, 0 if i < 6 else 1) for i in range(8)], "id long, c int")
    found = {r["id"]: r["fold"] for r in stratified_folds(df, "id", "c", 5, 1).collect()}
    sizes = fold_sizes(counts, 5)
    for c, per_fold in sizes.items():
        ids = range(6) if c == 0 else range(6, 8)
        assert [sum(1 for i in ids if found[i] == f) for f in range(5)] == per_fold


@pytest.mark.parametrize("blocks", [None, 1, 2, 9])
def test_running_with_a_hot_group(spark, blocks):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else rng.choice("abc"), rng.randint(0, 20), i, rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v int").repartition(6)
    out = ordering.running(df, ["g"], ["o", "id"], sums={"s": "v"}, maxima={"m": F.struct("v", "id")}, blocks=blocks)
    found = {r["id"]: (r["s"], tuple(r["m"])) for r in out.collect()}
    for g in {r[0] for r in rows}:
        total, best = 0, None
        for _, _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += v
            best = max(best, (v, i)) if best else (v, i)
            assert found[i] == (total, best)


@pytest.mark.parametrize("blocks", [None, 7])
def test_numbers_and_ranks(spark, blocks):
    rng = random.Random(6)
    rows = [(i, None if i % 2 else "g", float(rng.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    numbers = sorted(r["n"] for r in ordering.numbered(df, [], [-F.col("v"), "id"], "n", blocks).collect())
    assert numbers == list(range(1, 301))
    ranks = {r["id"]: r["r"] for r in ordering.competition_rank(df, ["g"], "v", "r", blocks=blocks).collect()}
    for i, g, v in rows:
        assert ranks[i] == 1 + sum(1 for _, h, w in rows if h == g and w > v)


def test_recorded_trial_ranks(spark):
    # Sizes of the groups of equal mean scores in a recorded search, best first.
    groups = [4, 4, 8, 4, 2, 2]
    rows = [(i, 1.0 - g / 10) for i, g in enumerate(g for g, n in enumerate(groups) for _ in range(n))]
    df = spark.createDataFrame(rows, "trial int, m double")
    ranks = [r["r"] for r in ordering.competition_rank(df, [], "m", "r").orderBy("trial").collect()]
    assert ranks == [1] * 4 + [5] * 4 + [9] * 8 + [17] * 4 + [21] * 2 + [23] * 2


def test_codes_follow_the_values(spark):
    df = spark.createDataFrame([(10.0,), (2.0,), (9.0,), (None,), (float("nan"),)], "v double")
    coded, dictionary = encode(df, "v")
    codes = {str(r["v"]): r["code"] for r in coded.collect()}
    assert codes == {"10.0": 2, "2.0": 0, "9.0": 1, "None": -1, "nan": -1}
    back = decode(coded, dictionary, out="w").where("code >= 0").collect()
    assert all(r["v"] == r["w"] for r in back)
