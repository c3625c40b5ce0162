"""Token counts of prefixes against the library."""

import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumiframe.llm import prefix_counts as pc
from lumiframe.llm import queries
from lumiframe.llm.prefix_counts import PrefixCounter, longest_prefix, packed, prefix_table, token_counts, tokens_before, unpacked

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "l", "'", "'ll", "'re", "'ve", " ", "  ", "\n", "\t", "the", " the", "1", "22", "!", "==", "é", "ß", "日", "本", " ", "Ꟛ", "<|endoftext|>", "<|endo", "|>", "ing", "　", "😀", "s", "'s", "\x1c", "\x85", "A", "Hello", "aaaa", "\U0001e6c0", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


def test_every_prefix_equals_the_library(library):
    counter = PrefixCounter(PATH)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(16)))
        assert np.cumsum(counter.changes(text)).tolist() == plain(library, text), text


def test_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(pc, "UNIT_BYTES", 3000)
    monkeypatch.setattr(pc, "PAIRS", 5)
    monkeypatch.setattr(pc, "UNIT_CHARS", 4)
    counter = PrefixCounter(PATH)
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))
        assert np.cumsum(counter.changes(text)).tolist() == plain(library, text), text


def test_packed_round_trip():
    for changes in ([], [1, 0, -3], [200, -150, 1], [-128, 127]):
        assert unpacked(packed(np.array(changes, np.int32))).tolist() == np.cumsum(changes).tolist()


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}])
def test_other_tokenizers_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    (tmp_path / "t.json").write_text(json.dumps(spec | change))
    with pytest.raises(ValueError):
        PrefixCounter(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_answers_from_the_table(spark, library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "", 2), (3, "again the", "", 2), (3, "again the", "", 2), (99, "", "", 0), (100, None, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, id int")
    table = longest_prefix(prefix_table(df, PATH), 9)
    asked = table.select("id", "n_bytes", "n_chars", "n_tokens", "fit_chars", tokens_before(F.col("prefix_counts"), F.lit(7)).alias("at"), tokens_before(F.col("prefix_counts"), F.lit(0)).alias("none"))
    expected = []
    for i, text, *_ in rows:
        counts = [0, *plain(library, text or "")]
        fit = max(k for k, c in enumerate(counts) if c <= 9)
        expected.append((i, len((text or "").encode()), len(text or ""), counts[-1], fit, counts[:8][-1], 0))
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r) for r in asked.collect()), key=key) == sorted(expected, key=key)
    assert longest_prefix(prefix_table(df, PATH), -1).where("fit_chars is not null").count() == 0


def test_very_long_text_and_empty_table(spark, library):
    text = "word, " * 200_000 + "=" * 3000 + "x" * 5000
    found = token_counts(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), PATH).collect()[0]
    assert found["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids) and found["over_limit"]
    assert len(library.encode(text[: found["fit_chars"]], add_special_tokens=False).ids) <= 1024
    assert token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_query_equals_the_library(spark, data, library):
    rows = {r["doc_id"]: r for r in queries.op11_token_counts(spark, data).collect()}
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc, text in texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = rows[doc]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 1024)
        assert r["fit_chars"] <= len(text or "") and (r["over_limit"] or r["fit_chars"] == len(text or ""))


def test_classes_of_plain_characters_equal_the_library():
    counter = PrefixCounter(PATH)
    for code in (*range(0x250), *range(0x2000, 0x2070)):
        char = chr(code)
        kinds = [k for k, s in (("a", pc._LETTERS), ("1", pc._NUMBERS), ("\n", pc._SPACES)) if re.match(f"[{s}]", char)]
        assert not pc._LATER.match(char) and (kinds or ["!"]) == [counter._class(code)], hex(code)
