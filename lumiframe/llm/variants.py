"""Spelling variants within one edit, found by pivotal grams."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log2
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Letters whose runs are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Grams are counted by this many hash values, so their table has a fixed size for any alphabet.
BUCKETS = 1 << 16
GRAM, EDITS = 2, 1
#: A shorter word has too few grams for two disjoint ones; from this length on words are joined by reference.
SHORTEST, LONG = 4, 64
#: Key rows that leave a task together.
ROWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 7, least: int = 2, hits: int = 31) -> DataFrame:
    """(word, n) of the letter runs of whole texts, A-Z lower-cased.

    With h the crc32 of ``<key>:<run>``, a run whose h is a multiple of ``hits``
    loses its code point h % length. Words have ``length`` code points and
    ``least`` occurrences at least. Null and empty texts have none, a null key
    counts as empty text, repeated rows count each, very long texts are read
    whole, an empty table gives no rows, other columns play no part.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0)))
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.withColumn("run", F.translate("run", UPPER, LOWER))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % hits == 0, shorter).otherwise(F.col("run")).alias("word")
    counts = rows.select(word).where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


def bucket(gram: str) -> int:
    return crc32(gram.encode()) % BUCKETS


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often grams of each hash value stand in the words; ``BUCKETS`` numbers at most reach the driver."""
    places = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = F.transform(places, lambda i: F.col("word").substr(i, F.lit(GRAM)))
    rows = words.where(F.length("word") >= GRAM).select(F.explode(grams).alias("gram"))
    hashed = (F.crc32(F.col("gram").cast("binary")) % BUCKETS).alias("bucket")
    counts = np.zeros(BUCKETS, np.int64)
    for value, n in rows.groupBy(hashed).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[value] = n
    return counts


def disjoint(places: list[int], weights: list[int], wanted: int = EDITS + 1, width: int = GRAM) -> list[int]:
    """Indices of ``wanted`` grams that share no character and have the least total weight.

    ``places`` ascend. Best sums of the first i grams with k chosen are built up
    gram by gram: each is left out, or taken after the last that ends before it.
    """
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * wanted]
    for i, place in enumerate(places):
        free = bisect_right(places, place - width)
        row = list(best[i])
        for k in range(1, wanted + 1):
            before = best[free][k - 1]
            if before is not None:
                taken = before[0] + weights[i], (*before[1], i)
                row[k] = taken if row[k] is None else min(row[k], taken)
        best.append(row)
    chosen = best[-1][wanted]
    if chosen is None:
        raise ValueError("too few grams")
    return list(chosen[1])


def _grams(word: str, rank) -> list[tuple[str, int]]:
    """(order, place) of the prefix: the rarest grams that edits and overlaps can spoil, one more, and ties of the last."""
    ranked = sorted((rank(word[i : i + GRAM]), i) for i in range(len(word) - GRAM + 1))
    last = ranked[min(GRAM * EDITS, len(ranked) - 1)][0]
    return [x for x in ranked if x[0] <= last]


def _number(hashed: xxhash.xxh64) -> int:
    return hashed.intdigest() - (1 << 63)


def _meets(word: str, places: list[int], tail: bool) -> list[int]:
    """For each gram, ascending, a hash of all from the near end through the gram and of the two letters at the far end."""
    hashed, at, found = xxhash.xxh64(f"]{word[:GRAM]}" if tail else f"[{word[-GRAM:]}"), 0, []
    shown = word[::-1] if tail else word
    for place in reversed(places) if tail else places:
        end = len(word) - place if tail else place + GRAM
        hashed.update(shown[at:end].encode())
        at = end
        found.append(_number(hashed))
    return found


def _ends(word: str, cut: int) -> list[int]:
    """Hashes of the word without ``cut`` letters at its end, and at its start."""
    return [_number(xxhash.xxh64(part.encode())) for part in ("<" + word[: len(word) - cut], ">" + word[cut:])]


def _keys(words: DataFrame, counts: np.ndarray, pivots: bool) -> DataFrame:
    """(key, word, n, size, last) with a row for each place where a word can meet another.

    ``words`` has (word, n, ref); ``ref`` stands for the word in the result. Of two
    words one edit apart, the edit leaves the left pivot with all before it or the
    right pivot with all behind it as they are, which fixes the gram's place from
    that end. Unless the edit is at the other end of the word, the two letters
    there stay too, so both go into one key; if it is there, all but these
    letters of the shorter word stay, and that is a key of its own with an empty
    ``last``. Pivots have one key for each end, prefix grams have both.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=BUCKETS)
        def rank(gram: str) -> str:
            return f"{counts[bucket(gram)]:016x}{gram}"

        names = ["key", "word", "n", "size", "last"]
        for batch in batches:
            rows = []
            for word, n, ref in zip(batch["word"], batch["n"].tolist(), batch["ref"]):
                prefix = _grams(word, rank)
                if pivots:
                    ranked = sorted(prefix[: GRAM * EDITS + 1], key=lambda x: x[1])
                    places = [place for _, place in ranked]
                    chosen = disjoint(places, [int(order[:16], 16) for order, _ in ranked])
                    meets = _meets(word, [places[chosen[0]]], False) + _meets(word, [places[chosen[-1]]], True)
                else:
                    places = sorted(place for _, place in prefix)
                    meets = _meets(word, places, False) + _meets(word, places, True)
                rows += [(key, ref, n, len(word), prefix[-1][0]) for key in meets]
                ends = _ends(word, GRAM) if pivots else _ends(word, GRAM) + _ends(word, GRAM + EDITS)
                rows += [(key, ref, n, len(word), "") for key in ends]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return words.mapInPandas(keyed, "key bigint, word string, n bigint, size int, last string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all words of ``words`` that differ in one code point, both ways round.

    ``words`` has distinct words of at least ``SHORTEST`` code points. The word whose last prefix gram comes
    first gives the pivots, and what survives of them stands in the prefix of the
    other.
    """
    counts = gram_counts(words)
    size = F.length("word")
    pairs = _met(words.where(size <= LONG).withColumn("ref", F.col("word")), counts)
    # Long words meet by reference, those at the border both ways: a word full of one gram has a key for each place.
    long_words = words.where(size >= LONG).withColumn("ref", F.sha2(F.col("word").cast("binary"), 256))
    far = _met(long_words, counts).select("word", "n", "other", "other_n").distinct()
    names = long_words.select(F.col("ref").alias("word"), F.col("word").alias("full"))
    others = long_words.select(F.col("ref").alias("other"), F.col("word").alias("other_full"))
    far = far.join(names, "word").join(others, "other").select(F.col("full").alias("word"), "n", F.col("other_full").alias("other"), "other_n")
    found = pairs.unionByName(far).where(F.levenshtein("word", "other", EDITS) == EDITS)
    turned = found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # A word has no more near words than its length times the alphabet, so none is hot.
    return found.unionByName(turned).repartition("word").dropDuplicates(["word", "other"])


def _met(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """(word, n, other, other_n) where a pivot of ``word`` is in the prefix of ``other`` within the place limits."""
    ours, others = _keys(words, counts, pivots=True), _keys(words, counts, pivots=False)
    others = others.select("key", *(F.col(c).alias(f"other_{c}") for c in ("word", "n", "size", "last")))
    near = (F.col("last") <= F.col("other_last")) & (F.col("size") - F.col("other_size")).between(-EDITS, EDITS)
    met = ours.join(others, "key").where(near & (F.col("word") != F.col("other_word")))
    return met.select("word", "n", F.col("other_word").alias("other"), "other_n")


def _last(forms: DataFrame, scratch: Scratch, steps: int) -> DataFrame:
    """(word, root): forms followed to the last one, twice as far each round."""
    roots = scratch.table(forms.select("word", F.col("form").alias("root")), "roots-0")
    for i in range(ceil(log2(steps)) if steps > 1 else 0):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        roots = scratch.table(joined, f"roots-{i + 1}")
        scratch.drop(f"roots-{i}")
    return roots


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced code point. ``form`` is
    the near word of largest n, the smallest in code-point order on ties, if that
    n is ``times`` the word's or more, else null; ``root`` is the last of the
    chain of forms, the word itself without one. Repeated words are added up,
    null words or counts go; words shorter than ``SHORTEST`` have too few grams
    and are compared through their single deletions; long words are taken whole;
    an empty table gives no rows; other columns play no part.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that chains of forms end")
    scratch = Scratch(words.sparkSession, "variants")
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = scratch.table(words, "words")
    pairs = near_pairs(words.where(F.length("word") >= SHORTEST)).unionByName(_short_pairs(words))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = pairs.groupBy("word").agg(F.first("n").alias("own"), F.countDistinct("other").alias("n_near"), best)
    near = near.withColumn("form_n", -F.col("best.n")).withColumn("form", F.col("best.word"))
    good = F.col("form_n") >= times * F.col("own")
    near = near.select("word", "n_near", *(F.when(good, F.col(c)).alias(c) for c in ("form", "form_n")))
    near = scratch.table(near, "near")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 0
    while times**steps <= most:  # a chain grows by ``times`` at each form
        steps += 1
    roots = _last(near.where("form is not null"), scratch, steps)
    found = words.join(near, "word", "left").join(roots, "word", "left")
    root, n_near = F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).alias("n_near")
    return found.select("word", "form", root, "n", n_near, "form_n")


def _short_pairs(words: DataFrame) -> DataFrame:
    """Pairs that hold a word shorter than ``SHORTEST``, by the texts that one deletion leaves."""
    some = words.where(F.length("word") <= SHORTEST)
    left = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: _without(F.col("word"), i))
    keys = F.explode(F.array_distinct(F.concat(F.array("word"), F.when(F.length("word") > 0, left).otherwise(F.array().cast("array<string>")))))
    keyed = some.select("word", "n", keys.alias("key"))
    others = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    short = F.least(F.length("word"), F.length("other")) < SHORTEST
    found = keyed.join(others, "key").where(short & (F.levenshtein("word", "other", EDITS) == EDITS))
    return found.select("word", "n", "other", "other_n").dropDuplicates(["word", "other"])


def _without(word: Column, i: Column) -> Column:
    return F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word)))


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the ``word_counts`` of ``df``, which say what odd rows give."""
    return variants(word_counts(df, key, text))
