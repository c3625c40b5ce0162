"""Benchmark decontamination by fingerprints of item-sized windows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import give_back

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which a window's fingerprint may differ from an item's. Texts of a few dozen shingles at the least similarity
#: differ in about ten of 64 bits, with a spread of three; ``tests/llm`` measure the recall. Of four blocks one then
#: differs in four of its 16 bits at most, which one value in 26 does by chance.
RADIUS, BLOCKS = 19, 4
#: Fingerprints that are looked up together, and pairs that are compared together.
QUERIES, PAIRS = 512, 1 << 20
#: Items that one pass over the documents looks for, and their characters at most.
ITEMS, ITEM_CHARS = 20_000, 32 * 1024 * 1024

_WORD = re.compile(r"\w+")
#: Odd multiplier of the rolling key over word numbers.
_MIX = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def similarity(one: list[str], other: list[str], k: int) -> float:
    """Weighted Jaccard similarity: shared occurrences of k-word shingles over occurrences in either."""
    a, b = (Counter(tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))) for x in (one, other))
    return (a & b).total() / (a | b).total()


def shingle_bits(tokens: list[str], k: int) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each shingle's hash."""
    n = max(1, len(tokens) - k + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + k]).encode()) for i in range(n)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bit sums: 1 where the sum is positive."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def masks(width: int, bits: int) -> np.ndarray:
    """All values of ``width`` bits of which at most ``bits`` are set."""
    sets = (c for n in range(bits + 1) for c in combinations(range(width), n))
    return np.array([sum(1 << bit for bit in c) for c in sets], np.uint64)


class HammingIndex:
    """Finds every fingerprint of a group within ``radius`` bits.

    Of ``blocks`` equal blocks one differs in at most radius // blocks bits. Two
    values so near have one between them, half of the bits from either, so a
    sorted table for each block has (group, value) for all values within the one
    half of an item's, a query looks up those within the other half of its own,
    and none is missed. The entries found are compared in full, a bounded number
    of them at a time.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS, groups: np.ndarray | None = None):
        self.prints, self.radius = prints, radius
        self.width = 64 // blocks
        near = radius // blocks
        self.probes = masks(self.width, near - near // 2)
        own = masks(self.width, near // 2)
        groups = np.zeros(len(prints), np.int64) if groups is None else groups
        self.tables = []
        for block in range(blocks):
            keys = self._keys(prints, block, own, groups).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], (order // len(own)).astype(np.int32)))

    def _keys(self, prints: np.ndarray, block: int, near: np.ndarray, groups) -> np.ndarray:
        values = (prints >> np.uint64(block * self.width)) & np.uint64((1 << self.width) - 1)
        groups = np.broadcast_to(np.asarray(groups, np.uint64), len(prints)) << np.uint64(self.width)
        return (values | groups)[:, None] ^ near[None, :]

    def search(self, queries: np.ndarray, group: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of the query, place of the print) within the radius."""
        different, back = np.unique(queries, return_inverse=True)
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(different), QUERIES):
            own = different[at : at + QUERIES]
            for block, table in enumerate(self.tables):
                found += [pairs + at * len(self.prints) for pairs in self._near(own, block, table, group)]
        q, p = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints)))
        # A fingerprint that many windows have was looked up once.
        order = np.argsort(back, kind="stable")
        first = np.searchsorted(back[order], np.arange(len(different) + 1))
        n = first[q + 1] - first[q]
        return order[_ranges(first[q], n)], np.repeat(p, n)

    def _near(self, queries: np.ndarray, block: int, table: tuple, group: int) -> Iterator[np.ndarray]:
        """Different numbers place of query * prints + place of print, of those that meet in a block."""
        keys, items = table
        probes = self._keys(queries, block, self.probes, group).ravel()
        start = np.searchsorted(keys, probes)
        n = np.searchsorted(keys, probes, side="right") - start
        hit = np.flatnonzero(n)
        ends = n[hit].cumsum()
        # A probe has an entry of an item once, so a part is over PAIRS by the items of a block at most.
        for part in np.split(hit, np.flatnonzero(np.diff(ends // PAIRS)) + 1):
            q = np.repeat(part // len(self.probes), n[part])
            p = items[_ranges(start[part], n[part])]
            near = np.bitwise_count(queries[q] ^ self.prints[p]) <= self.radius
            yield np.unique(q[near] * len(self.prints) + p[near])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the ranges, one after the other."""
    return np.arange(n.sum()) + np.repeat(start - n.cumsum() + n, n)


class Benchmark:
    """Items by size, their fingerprints, and the keys of their shingles."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        self.shingle, self.least = shingle, least
        self.items: dict[int, list[tuple]] = defaultdict(list)
        for key, text in items:
            if found := words(text):
                self.items[len(found)].append((key, found))
        # One index for all items; the group of an item is its size.
        self.placed = [(size, i) for size, own in self.items.items() for i in range(len(own))]
        sums = [shingle_bits(w, self.k(size)).sum(0) for size, own in self.items.items() for _, w in own]
        prints = pack(np.stack(sums)) if sums else np.zeros(0, np.uint64)
        self.index = HammingIndex(prints, radius, groups=np.array([size for size, _ in self.placed], np.int64))
        self.numbers: dict[str, int] = {}
        sizes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for size, own in self.items.items():
            for _, found in own:
                numbers = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in found])
                for key in self.keys(numbers, self.k(size)).tolist():
                    sizes[self.k(size)][key].add(size)
        self.seeds = {k: (np.array(sorted(own), dtype=np.uint64), own) for k, own in sizes.items()}

    def k(self, size: int) -> int:
        """Words of a shingle; an item of fewer words is one shingle."""
        return min(self.shingle, size)

    @staticmethod
    def keys(numbers: np.ndarray, k: int) -> np.ndarray:
        """Rolling key of every k consecutive word numbers."""
        own = numbers.astype(np.uint64)
        total = np.zeros(max(0, len(own) - k + 1), np.uint64)
        for i in range(k):
            total = (total + own[i : i + len(total)] + np.uint64(1)) * np.uint64(_MIX)
        return total

    def places(self, numbers: np.ndarray) -> dict[int, np.ndarray]:
        """By item size, the starts of windows that share a shingle with an item of that size.

        A window without such a shingle has similarity zero to every item of its size.
        """
        n = len(numbers)
        marked: dict[int, np.ndarray] = {}
        for k, (seeds, sizes) in self.seeds.items():
            keys = self.keys(numbers, k)
            # A shingle with a word that no item has cannot be an item's.
            outside = np.concatenate(([0], np.cumsum(numbers < 0)))
            inside = np.flatnonzero(outside[k:] == outside[: max(0, len(outside) - k)]) if n >= k else np.zeros(0, int)
            at = np.searchsorted(seeds, keys[inside])
            hit = inside[seeds[np.minimum(at, len(seeds) - 1)] == keys[inside]] if len(seeds) else inside[:0]
            for place in hit.tolist():
                for size in sizes[int(keys[place])]:
                    starts = marked.setdefault(size, np.zeros(max(1, n - size + 1), dtype=bool))
                    first = max(0, min(place + k - size, len(starts) - 1))
                    starts[first : place + 1] = True
        return {size: np.flatnonzero(starts) for size, starts in marked.items()}

    def find(self, text: str | None) -> list[tuple]:
        """(item key, first word, words, similarity, differing bits) of the best window for each item found."""
        tokens = words(text)
        if not tokens or not self.items:
            return []
        number = self.numbers.get
        numbers = np.array([number(w, -1) for w in tokens])
        best: dict[tuple, tuple] = {}
        for size, starts in self.places(numbers).items():
            k = self.k(size)
            spread = min(size, len(tokens))
            n = max(1, spread - k + 1)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
                low = int(run[0])
                part = tokens[low : int(run[-1]) + spread]
                sums = np.concatenate((np.zeros((1, 64), np.int32), shingle_bits(part, k).cumsum(0)))
                prints = pack(sums[run - low + n] - sums[run - low])
                for q, at in zip(*self.index.search(prints, size)):
                    p = self.placed[at][1]
                    key, own = self.items[size][p]
                    start = int(run[q])
                    value = similarity(tokens[start : start + spread], own, k)
                    if value >= self.least:
                        bits = int(np.bitwise_count(prints[q] ^ self.index.prints[at]))
                        old = best.get((size, p))
                        if old is None or (-value, start) < (-old[3], old[1]):
                            best[size, p] = (key, start, spread, value, bits)
        return list(best.values())


def benchmark_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, in key order."""
    block, chars = [], 0
    rows = benchmark.select(F.col(key).alias("id"), F.col(text).alias("text")).orderBy("id", "text")
    for row in rows.toLocalIterator():
        if block and (len(block) >= ITEMS or chars + len(row["text"] or "") > ITEM_CHARS):
            yield block
            block, chars = [], 0
        block.append((row["id"], row["text"]))
        chars += len(row["text"] or "")
    if block:
        yield block


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    least: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(key, item_key, first_word, n_words, similarity, bits): the best window of each document for each item found.

    Words are lower-cased runs of word characters. A window has as many words as
    the item (the whole document where that is shorter). Windows that share a
    shingle with an item of their size are fingerprinted, the index gives every
    fingerprint within ``radius``, and weighted shingle similarity of at least
    ``least`` decides. Items and documents without words match nothing; items of
    fewer words than a shingle are one shingle; null keys are carried along;
    repeated documents and items give a row for each pair; ties go to the earliest
    window; empty tables give no rows; other columns play no part.

    Nothing is shuffled. The benchmark goes to the tasks in blocks of bounded
    size, one pass over the documents each.
    """
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField(item_key, benchmark.schema[item_key].dataType),
            T.StructField("first_word", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("bits", T.IntegerType()),
        ]
    )
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = df.sparkSession.createDataFrame([], schema)
    for block in benchmark_blocks(benchmark, item_key, item_text):
        found = found.unionByName(docs.mapInPandas(_searcher(block, schema, shingle, least, radius), schema))
    return found


def _searcher(block: list[tuple], schema: T.StructType, shingle: int, least: float, radius: int):
    names = schema.names

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Benchmark(block, shingle, least, radius)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch["id"], batch["text"]) for hit in index.find(t)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return search


def is_leaked(benchmark: DataFrame, text: Column, item_key: str = "item_id", item_text: str = "text") -> Column:
    """Whether a document holds a window that ``leaks`` would report, as a column of its own row."""
    result = F.lit(False)
    for block in benchmark_blocks(benchmark, item_key, item_text):
        result = result | _flag(block)(text)
    return result


def _flag(block: list[tuple]):
    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Benchmark(block)
        for batch in batches:
            yield pd.Series([bool(index.find(t)) for t in batch], dtype=bool)
        give_back()

    return found
