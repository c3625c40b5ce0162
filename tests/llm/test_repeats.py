"""Periodic runs against a plain scan over all periods."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from lumiframe.llm import queries
from lumiframe.llm.repeats import collapsed, grammar, runs_of, word_runs


def plain_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(least, times * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rng, letters, most):
    words = []
    while len(words) < rng.randrange(10, most):
        block = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
        words += block if rng.random() < 0.5 else block * rng.randrange(2, 9) + block[: rng.randrange(len(block))]
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (10, 4), (40, 5)])
def test_runs_equal_plain_scan(least, times):
    rng = random.Random(least)
    total = 0
    for _ in range(400):
        words = periodic(rng, rng.choice([1, 2, 2, 3, 5]), 160)
        expected = plain_runs(words, least, times)
        total += len(expected)
        assert runs_of(words, least, times) == expected
    assert total > 100


@pytest.mark.parametrize("n", [23, 24, 25, 1000, 4096])
def test_one_word_again_and_again(n):
    assert runs_of([b"a"] * n) == ([(0, n, 1)] if n >= 24 else [])


def test_grammar_places_hold_equal_words():
    rng = random.Random(8)
    for _ in range(100):
        ids = np.array([int(w) for w in periodic(rng, 3, 200)])
        covered = np.zeros(len(ids) - 1, bool)
        for first, middle, end, places in grammar(ids):
            assert first < middle < end
            assert all(np.array_equal(ids[p : p + end - first], ids[first:end]) for p in places)
            covered[places + middle - first - 1] = True
        assert covered.all()  # each border of two words is the boundary of one derivation


def odd_rows():
    return [(1, None), (2, ""), (3, " \t\x0b"), (None, "b c " * 20), (4, "x " + "a b c " * 9), (4, "x " + "a b c " * 9), (5, "é\x1c " * 30), (6, "w " * 60_000), (7, "one two")]


def plain_row(words):
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, b" ".join(w for i, w in enumerate(words) if i not in drop).decode()


def test_odd_rows(spark):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in odd_rows()], "doc_id bigint, text string, runs string, id int")
    found = sorted(((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in word_runs(df).collect()))
    expected = []
    for d, t in odd_rows():
        words = (t or "").encode().split()
        runs, kept = plain_row(words) if len(words) < 1000 else ([(0, len(words), 1)], "w")
        expected.append((str(d), runs, kept))
    assert found == sorted(expected)


def test_empty_table(spark):
    assert word_runs(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_collapsed_keeps_first_periods():
    words = [b"a", *[b"b", b"c"] * 15, b"d"]
    assert collapsed(words, runs_of(words)) == "a b c d"


def test_query_equals_brute_force(spark, data):
    rows = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, data).collect()}
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    with_runs = 0
    for doc, text in texts:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        h, n = crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # the plain scan takes n * n steps
        runs, kept = plain_row(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        r = rows[doc]
        assert (r["start"], r["length"], r["period"]) == best and r["n_runs"] == len(runs)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 5
