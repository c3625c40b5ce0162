"""Stupid backoff against counting and scoring by the definition."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumiframe.llm import backoff
from lumiframe.llm.backoff import backoff_scores, pack_numbers, pack_sorted, unpack_numbers, unpack_sorted
from lumiframe.llm.queries import ORACLES, QUERIES


def plain(rows, order, own):
    docs = [(t or "").lower().split() for _, t in rows]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    counts = {n: Counter(g for w in docs for g in grams(w, n)) for n in range(1, order + 1)}
    total = sum(map(len, docs))
    out = []
    for (d, _), w in zip(rows, docs):
        mine = {n: Counter(grams(w, n)) for n in range(1, order + 1)}
        left = lambda g: counts[len(g)][g] - (0 if own else mine[len(g)][g])
        n_others = max(1, total - (0 if own else len(w)))
        score = 0.0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log((left(gram) or 0.5) / n_others) + (longest - 1) * math.log(0.4)
                elif left(gram) > 0:
                    score += math.log(left(gram) / left(gram[:-1])) + (longest - n) * math.log(0.4)
                    break
        out.append((str(d), len(w), round(score, 6)))
    return sorted(out)


def rows():
    rng = random.Random(6)
    out = [(i, " ".join(rng.choice(["a", "B", "c", "dd", "é", "the"]) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    return out + [(None, "a b c"), (7, "the the the"), (7, "the the the"), (900, None), (901, ""), (902, "only once here")]


@pytest.mark.parametrize("order,own,tokens,entries", [(3, False, 50, 40), (3, True, 2_000_000, 2_000_000), (1, False, 300, 100), (4, False, 1000, 7)])
def test_scores(spark, monkeypatch, order, own, tokens, entries):
    monkeypatch.setattr(backoff, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(backoff, "PART_ENTRIES", entries)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows()], "doc_id bigint, text string, block int, ids string").repartition(3)
    found = backoff_scores(df, order=order, own=own).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.log_score, 6)) for r in found) == plain(rows(), order, own)
    assert all((r.mean_log_score is None) == (r.n_tokens == 0) for r in found)


def test_long_text_and_empty_table(spark):
    long = [(2**60 + 1, "w " * 200_000), (1, "w")]
    df = spark.createDataFrame(long, "doc_id bigint, text string")
    found = {r.doc_id: r for r in backoff_scores(df).collect()}
    assert found[2**60 + 1].n_tokens == 200_000 and found[1].log_score == pytest.approx(0.0)
    assert backoff_scores(df.limit(0)).collect() == []


def test_query_matches_sql(spark, data):
    name = "op2_backoff_scores"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    df = QUERIES[name](spark, data)
    cursor = con.execute(ORACLES[name])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, cursor.fetchall()))


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for high in (1, 300, 2**40, 2**56):
        values = np.sort(rng.integers(0, high, 1000, dtype=np.uint64))
        assert (unpack_numbers(pack_numbers(values)) == values).all() and (unpack_sorted(pack_sorted(values)) == values).all()
    assert len(unpack_numbers(pack_numbers(np.zeros(0, np.uint64)))) == 0
