"""SimHash fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumiframe.llm.simhash import bucket_stars, chain_keys, fingerprint, links, simhash_components


def plain_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows, bits=3):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted((str(d), f"{p:016x}", str(least.get(x))) for (d, _), p, x in zip(rows, prints, label))


def near_copies(rng):
    base = [rng.choice("alpha beta gamma delta eta Zeta IOTA ünder straße".split()) + str(rng.randrange(300)) for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(400)] = f"x{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(rng.choice(base) for _ in range(200))) for i in range(20)]
    return rows


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one TWO", "a b c d\x0be\x0cf", "É é\x1cx a b c", "w " * 9000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    rows = near_copies(rng) + [(1, ""), (2, None), (3, " "), (None, "one two"), (4, "one two"), (4, "one two"), (None, "only null key here")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id bigint, text string, fingerprint string, id int")
    found = simhash_components(df)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(a), b, str(c)) for a, b, c in found.collect()) == plain_components(rows)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_chain_keys_miss_no_pair(bits):
    rng = random.Random(bits)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(bits + 1)):
            y ^= 1 << b
        pair = np.array([x, y], dtype=np.uint64)
        met = False
        owners = {(s, int(k), int(r)) for s, keys, rows, probe in chain_keys(pair, bits) if not probe for k, r in zip(keys, rows)}
        for s, keys, rows, probe in chain_keys(pair, bits):
            for k, r in zip(keys, rows):
                if (s, int(k), 1 - int(r)) in owners:
                    met |= bool(bucket_stars(pair[[1 - r, r]], np.array([False, probe]), s, bits)) or x == y
        assert met


def test_large_bucket_in_parts(spark, monkeypatch):
    from lumiframe.llm import simhash

    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    rows = near_copies(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((str(a), b, str(c)) for a, b, c in simhash_components(df).collect())
    assert found == plain_components(rows)


def test_buckets_are_not_sent_through_the_driver(spark, tmp_path):
    """A few bytes a fingerprint become dozens of buckets each: their size as Spark guesses it says nothing."""
    spark.range(2000).select(F.xxhash64("id").alias("fingerprint")).write.parquet(f"file://{tmp_path}/prints")
    found = links(spark.read.parquet(f"file://{tmp_path}/prints"), 3)
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
