"""The pipeline: stage by stage against brute force, planted documents, odd rows."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumiframe.llm.decontaminate import Benchmark
from lumiframe.llm.simhash import one_of_each
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import near_copies, plain_components


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "source_mixing", "token_files"]


def test_one_of_each_keeps_one(spark):
    rows = near_copies(random.Random(9)) + [(1, ""), (2, None), (None, "alone and null"), (None, "alone and null"), (4, "one two"), (4, "one two"), (4, "another text here")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, id string, root int")
    found = one_of_each(df)
    assert found.columns == df.columns
    kept = Counter((r.doc_id, r.text or "") for r in found.collect())
    assert set(kept.values()) == {1}
    groups = {c: f for _, f, c in plain_components([r for r in rows if r[0] not in (4, None)])}
    ids = {str(d) for d, _ in kept if d not in (4, None)}
    assert ids == set(groups)
    assert {t for d, t in kept if d == 4} == {"one two", "another text here"}
    assert {t for d, t in kept if d is None} == {"alone and null"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with planted toxic, copied and leaked documents."""
    rng = random.Random(4)
    words = [a + b for a in "ka lo mi nu pe ro su ti".split() for b in "ta se vi do gu ra".split()]
    folder = tmp_path_factory.mktemp("tables")
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(5)]
    docs, labels, planted = [], [], {"toxic": set(), "copy": set(), "leak": set()}
    for i in range(400):
        body = [rng.choice(words) for _ in range(60 + i % 40)]
        if i % 5 == 0:
            body[10:10] = ["scumling", "idiotling"]
            planted["toxic"].add(i)
        elif i % 23 == 0:
            body[5:5] = items[i % 5][1].split()
            planted["leak"].add(i)
        elif i % 17 == 0:
            body = docs[i - 1][1].split() if i - 1 not in planted["toxic"] | planted["leak"] | planted["copy"] else body
            if body is docs[i - 1][1] or " ".join(body) == docs[i - 1][1]:
                planted["copy"].add(i)
        docs.append((i, " ".join(body), "en", "big" if i % 3 else f"s{i % 7}", 0))
        labels.append((i, 1, int(i in planted["toxic"])))
    docs += [(9000, None, None, None, None), (9001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items, planted


def test_each_stage(spark, tables):
    folder, docs, items, planted = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["toxicity"](spark, frame, folder)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {d[0] for d in docs} - planted["toxic"]
    rows = [(d[0], d[1]) for d in docs]
    kept = stages["simhash_near_dedup"](spark, frame, folder)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({c for _, _, c in plain_components(rows)})
    clean = stages["decontamination"](spark, frame, folder)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in brute(rows, items)}
    assert planted["leak"] <= {d for d, t in rows if Benchmark(items).find(t)}


def test_run(spark, tables):
    """All stages in a row; the last one holds the tokens of what the mix took."""
    folder, docs, items, planted = tables
    found = corpus_pipeline.run(spark, folder).collect()
    gone = planted["toxic"] | planted["copy"] | planted["leak"] | {9001}
    counts = Counter(r.doc_id for r in found)
    assert not set(counts) & gone
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = {d[0]: len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids) + 1 for d in docs}
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (start, by_id[r.doc_id])
        start += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted(r.doc_id for r in found)
    assert len(set(counts)) > 150


def test_empty_documents(spark, tables, tmp_path):
    folder, *_ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
