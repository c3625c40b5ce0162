"""Spelling variants and their pivots against brute force."""

import itertools
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from lumiframe.llm import queries
from lumiframe.llm.variants import disjoint, spelling_variants, variants, word_counts

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) > 1000:  # only runs of one letter in these tests
        return len(a) + 1 == len(b) and len(set(a + b)) == 1
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    rows = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(rows)


def collected(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_disjoint_is_the_best_choice():
    rng = random.Random(1)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        weights = [rng.randrange(9) for _ in places]
        sets = [c for c in itertools.combinations(range(len(places)), 2) if places[c[1]] - places[c[0]] >= 2]
        chosen = disjoint(places, weights)
        assert tuple(chosen) in sets
        assert sum(weights[i] for i in chosen) == min(sum(weights[i] for i in c) for c in sets)


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzÀÿ"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(letters)
    words = {}
    while len(words) < 400:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 12)))
        for _ in range(4):
            words[word] = rng.choice([2, 3, 25, 40, 300, 4000])
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
            if len(word) < 7:
                break
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n bigint, key string")
    assert collected(variants(df)) == plain_variants(words)


def test_short_words(spark):
    words = {"".join(w): 2 + i for i, w in enumerate(w for k in range(6) for w in itertools.product("ab", repeat=k))}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert collected(variants(df)) == plain_variants(words)


def test_counts_of_odd_rows(spark):
    rng = random.Random(4)
    vocabulary = ["Überzeugung", "überzeugung", "necessary", "neccessary", "NECESSARY", "naïveté", "short", "xÿzzyxÿz", "aaaaaaaa"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(200)]
    rows += [(i, w) for i in range(4) for w in ("b" * 64, "b" * 65, "b" * 63, "c" + "b" * 64, "a" * 4_999)]
    rows += [(1, None), (2, ""), (None, "necessary, necessary; naïveté"), (3, "a" * 5_000), (3, "a" * 5_000), (5, "necessary1necessary_neceśsary×ok÷long")]
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id bigint, text string, n int, word string, h string")
    assert {r["word"]: r["n"] for r in word_counts(df).collect()} == plain_words(rows)
    assert collected(spelling_variants(df)) == plain_variants(plain_words(rows))


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(queries.op13_spelling_variants(spark, data)) == plain_variants(plain_words(rows))
