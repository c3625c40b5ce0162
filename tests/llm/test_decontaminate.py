"""Decontamination against all windows, the index against all fingerprints."""

import random

import numpy as np
import pytest

from lumiframe.llm import decontaminate
from lumiframe.llm.decontaminate import Benchmark, HammingIndex, is_leaked, leaks, similarity, words

rng = random.Random(11)
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("ta", "se", "vi", "do", "gu", "é")]


def passage(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, it in items:
            own = words(it)
            if not w or not own:
                continue
            k, size = min(5, len(own)), min(len(own), len(w))
            if max(similarity(w[s : s + size], own, k) for s in range(len(w) - size + 1)) >= 0.8:
                out.add((d, i))
    return out


def edited(item):
    w = list(item)
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(at, "zzz"), lambda: w.insert(at, "yyy"), lambda: w.pop(at)])()
    return w


def cases():
    items = [(i, " ".join(passage(rng.choice([3, 17, 25, 60, 60, 90])))) for i in range(25)]
    docs = []
    for d in range(220):
        body = passage(rng.randrange(0, 120))
        if d % 2:
            item = edited(rng.choice(items)[1].split())
            at = rng.randrange(len(body) + 1)
            body = body[:at] + item + body[at:]
        docs.append((d, ", ".join(body).upper() if d % 3 else "\n".join(body)))
    return docs, items


def test_every_window_is_found(spark):
    docs, items = cases()
    expected = brute(docs, items)
    assert len(expected) > 40
    index = Benchmark(items)
    assert {(d, h[0]) for d, t in docs for h in index.find(t)} == expected
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    flagged = df.where(is_leaked(bench, df["text"])).select("doc_id").collect()
    assert {r.doc_id for r in flagged} == {d for d, _ in expected}


@pytest.mark.parametrize("radius,blocks", [(24, 8), (7, 8), (3, 4), (20, 4)])
def test_index_finds_all_within_the_radius(radius, blocks):
    own = np.array([rng.getrandbits(64) for _ in range(50)], dtype=np.uint64)
    queries = []
    for x in own.tolist():
        for b in rng.sample(range(64), rng.randrange(radius + 4)):
            x ^= 1 << b
        queries.append(x)
    queries = np.array(queries, dtype=np.uint64)
    q, p = HammingIndex(own, radius, blocks).search(queries)
    apart = np.bitwise_count(queries[:, None] ^ own[None, :])
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))


def test_index_keeps_groups_apart():
    own = np.array([rng.getrandbits(64) for _ in range(40)] * 3, dtype=np.uint64)
    groups = np.repeat([2, 17, 100_000], 40)
    index = HammingIndex(own, 19, 4, groups)
    queries = np.concatenate((own[:40], own[:5], np.array([rng.getrandbits(64)], np.uint64)))
    for group in (2, 17, 100_000, 5):
        q, p = index.search(queries, group)
        apart = (np.bitwise_count(queries[:, None] ^ own[None, :]) <= 19) & (groups == group)
        assert sorted(zip(q.tolist(), p.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(apart))))
    assert HammingIndex(own[:0]).search(queries)[0].size == 0


def test_index_in_small_parts(monkeypatch):
    monkeypatch.setattr(decontaminate, "QUERIES", 7)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    test_index_finds_all_within_the_radius(20, 4)


def test_blocks_prune():
    """What shares a block's neighbourhood by chance is a small part of all pairs."""
    own = np.array([rng.getrandbits(64) for _ in range(200)], dtype=np.uint64)
    queries = np.array([rng.getrandbits(64) for _ in range(500)], dtype=np.uint64)
    shift = np.arange(0, 64, 64 // decontaminate.BLOCKS, dtype=np.uint64)
    blocks = [(x[:, None] >> shift) & np.uint64((1 << 64 // decontaminate.BLOCKS) - 1) for x in (queries, own)]
    near = np.bitwise_count(blocks[0][:, None, :] ^ blocks[1][None, :, :]) <= decontaminate.RADIUS // decontaminate.BLOCKS
    assert near.any(axis=2).mean() < 0.2


def test_recall_of_the_radius():
    """Share of texts at a similarity of 0.8 to 0.9 whose fingerprints are within the radius, by size."""
    many = [f"w{i}" for i in range(3000)]
    for size in (17, 25, 40, 80, 200):
        hits = total = 0
        for _ in range(600):
            one = rng.choices(many, k=size)
            other = list(one)
            for _ in range(rng.randrange(1, size // 25 + 3)):
                other[rng.choice([0, 1, 2, size - 1, rng.randrange(size)])] = rng.choice(many)
            if 0.8 <= similarity(one, other, 5) <= 0.9:
                prints = decontaminate.pack(np.stack([decontaminate.shingle_bits(x, 5).sum(0) for x in (one, other)]))
                hits, total = hits + (np.bitwise_count(prints[0] ^ prints[1]) <= decontaminate.RADIUS), total + 1
        assert total >= 20 and hits >= 0.99 * total, (size, hits, total)


def test_text_made_of_pieces_of_many_items():
    many = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(many, k=30))) for i in range(300)]
    pieces = [" ".join(i[1].split()[at : at + 7]) for i in items for at in (0, 11, 20)]
    rng.shuffle(pieces)
    pieces.insert(450, items[41][1])
    assert [h[0] for h in Benchmark(items).find(" ".join(pieces))] == [41]


def test_blocks_of_items(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontaminate, "ITEMS", 10)
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs, items)


def test_odd_rows(spark):
    item = " ".join(passage(30))
    docs = [(None, item), (1, None), (2, ""), (3, item), (3, item), (4, "word " * 100000 + item), (5, "!?")]
    items = [(7, item), (None, item), (8, None), (9, ""), (10, "..."), (7, item)]
    found = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    pairs = sorted((str(r.doc_id), str(r.item_id), r.similarity) for r in found.collect())
    assert pairs == sorted((d, i, 1.0) for d in ("None", "3", "3", "4") for i in ("7", "None", "7"))
    assert {r.n_words for r in found.collect()} == {30}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks(docs, items).collect() == [] and docs.where(is_leaked(items, docs["text"])).collect() == []
    assert leaks(docs.limit(0), docs.toDF("item_id", "text")).collect() == []
