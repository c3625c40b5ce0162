"""Mixing: the exponent, the budgets, and the rows against SQL."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from lumiframe.llm import mixing
from lumiframe.llm.mixing import exponent, mix, mixed_rows
from lumiframe.llm.queries import ORACLES, QUERIES


def shares_of(spark, counts):
    return spark.createDataFrame([(c / sum(counts),) for c in counts], "share double")


def weights(counts, a):
    z = sum((c / sum(counts)) ** a for c in counts)
    return [(c / sum(counts)) ** a / z for c in counts]


def test_exponent_meets_the_entropy(spark):
    counts = [900, 50, 30, 20]
    a = exponent(shares_of(spark, counts), 0.8, 1000.0, 1.0)
    found = -sum(w * math.log(w) for w in weights(counts, a))
    assert 0 < a < 1 and found == pytest.approx(0.8 * math.log(4), rel=1e-9)


def test_exponent_meets_the_limit(spark):
    counts = [900, 50, 30, 20]
    a = exponent(shares_of(spark, counts), 0.99, 3.0, 1.0)
    assert max(w * 1000 / c for w, c in zip(weights(counts, a), counts)) == pytest.approx(3.0, rel=1e-9)


@pytest.mark.parametrize("counts,entropy,limit,budget,expected", [([5], 0.9, 2, 1, 1), ([5, 5], 0.9, 2, 1, 1), ([9, 1], 0.1, 2, 1, 1), ([9, 1], 1.0, 1.0, 1.0, 1), ([9, 1], 0.9, 1.0, 3.0, 1)])
def test_exponent_at_the_ends(spark, counts, entropy, limit, budget, expected):
    assert exponent(shares_of(spark, counts), entropy, limit, budget) == expected


def corpus():
    rows = []
    for i in range(900):
        source = "big" if i % 3 else ("mid" if i % 2 else "tiny" if i % 12 == 0 else None)
        rows.append((i, " ".join(["w"] * (5 + i % 17)), source, i))
    return rows


def test_budgets_are_met(spark):
    rows = corpus() + [(5000, None, "silent", 1), (5001, "", "silent", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int")
    found = mix(df, repetition=3.0).collect()
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    counted = {s: n for s, n in tokens.items() if n}
    a = exponent(shares_of(spark, list(counted.values())), 0.95, 3.0, 1.0)
    total = sum(counted.values())
    taken, per_doc = Counter(), defaultdict(list)
    for r in found:
        taken[r.source] += r.n_tokens
        per_doc[r.doc_id].append(r.epoch)
    for s, w in zip(counted, weights(list(counted.values()), a)):
        assert abs(taken[s] - w * total) < 150  # a block
    assert taken["tiny"] > counted["tiny"] and taken["big"] < counted["big"]
    assert all(sorted(e) == list(range(len(e))) or len(set(e)) == len(e) for e in per_doc.values())
    assert per_doc[5000] == per_doc[5001] == [0]
    whole = mixed_rows(df, repetition=3.0)
    assert whole.columns == df.columns
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in found)


def test_documents_without_tokens_are_not_repeated(spark):
    df = spark.createDataFrame([(i, "w w" if i % 2 else "", "one") for i in range(600)], "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in mixed_rows(df).collect()) == list(range(600))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", None, 1), (None, "a b", None, 1), (1, None, None, 1), (1, "", "", 1)], "doc_id bigint, text string, source string, s int")
    assert mixed_rows(df).count() >= 3
    assert mixed_rows(df.limit(0)).collect() == [] and mix(df.limit(0)).collect() == []
    silent = df.where("text is null")
    assert mixed_rows(silent).count() == 1


def test_query_matches_sql(spark, data, monkeypatch):
    name = "op7_source_mixing"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    df = QUERIES[name](spark, data)
    cursor = con.execute(ORACLES[name])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
    assert mixing.HALVINGS % mixing.AHEAD == 0
