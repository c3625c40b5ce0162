"""Periodic runs of words, found on a grammar of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]
#: (first word, word at the boundary, word behind the end) of a node, and all places where it is derived.
Node = tuple[int, int, int, np.ndarray]


def _windows(values: np.ndarray, seed: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4, ... words from each place on, up to half the text and a level more."""
    mix = np.random.default_rng(seed).integers(1 << 62, size=2, dtype=np.uint64) | np.uint64(1)
    levels, width = [values.astype(np.uint64) * mix[0]], 1
    while 2 * width <= len(values):
        one = levels[-1]
        levels.append(one[:-width] * mix[0] + (one[width:] ^ (one[width:] >> np.uint64(29))) * mix[1])
        width *= 2
    return levels


def may_repeat(words: list[bytes], least: int) -> bool:
    """False if no run is in the text: two thirds of a run come again one period later."""
    width = 1 << ((2 * least // 3).bit_length() - 1)
    if len(words) < least:
        return False
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    while width > 1:  # hashes of windows twice as long, and the window is a power of two
        step = len(words) - len(hashes) + 1
        hashes = hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + (hashes[step:] ^ (hashes[step:] >> np.uint64(29)))
        width //= 2
    hashes = np.sort(hashes)
    return bool((hashes[1:] == hashes[:-1]).any())


def grammar(ids: np.ndarray) -> Iterator[Node]:
    """Nonterminals of a Re-Pair grammar of ``ids``, then those of a balanced tree over what is left.

    A round replaces each pair of symbols where it is more frequent than the pairs
    that overlap it, so the most frequent pair of all is always replaced; the
    rounds end when no pair comes twice. Every replacement is a place where the
    text derives the nonterminal.
    """
    symbols, at = ids.astype(np.int64), np.arange(len(ids) + 1)  # the end stands behind the last symbol
    fresh = int(ids.max()) + 1 if len(ids) else 0
    while len(symbols) > 1:
        keys = symbols[:-1] << np.int64(32) | symbols[1:]
        place = np.arange(len(keys))
        same = np.concatenate(([False], keys[1:] == keys[:-1]))
        odd = (place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 1  # every other pair of equal symbols overlaps
        pairs, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        counts -= np.bincount(which[odd], minlength=len(pairs))
        if counts.max() < 2:
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(pairs))
        rank = np.where(odd | (counts[which] < 2), -1, rank[which])
        beside = np.concatenate(([-1], rank, [-1]))
        chosen = np.flatnonzero((rank > beside[:-2]) & (rank > beside[2:]))
        used = np.bincount(which[chosen], minlength=len(pairs))
        chosen = chosen[used[which[chosen]] > 1]
        order = chosen[np.argsort(which[chosen], kind="stable")]
        for places in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            first = places[0]
            yield int(at[first]), int(at[first + 1]), int(at[first + 2]), at[places]
        symbols[chosen] = fresh + which[chosen]
        fresh += len(pairs)
        stays = np.ones(len(symbols), bool)
        stays[chosen + 1] = False
        symbols, at = symbols[stays], at[np.append(stays, True)]
        if fresh >= 1 << 31:
            symbols = np.unique(symbols, return_inverse=True)[1]
            fresh = len(symbols)
    while len(at) > 2:
        for a, m, b in zip(at[:-2:2].tolist(), at[1:-1:2].tolist(), at[2::2].tolist()):
            yield a, m, b, np.array([a])
        odd_end = at[-1:] if len(at) % 2 == 0 else at[:0]
        at = np.concatenate((at[::2], odd_end))


def _common(levels: list[np.ndarray], one: np.ndarray, other: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal from ``one`` and ``other`` on, or before them, ``most`` at most."""
    length = np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        for _ in range(2 if k == len(levels) - 1 else 1):
            fits = length + width <= most
            a = np.where(fits, one - length - width if back else one + length, 0)
            b = np.where(fits, other - length - width if back else other + length, 0)
            length += np.where(fits & (levels[k][a] == levels[k][b]), width, 0)
    return length


def _crossing(nodes: list[Node], ids: np.ndarray, levels: list[np.ndarray], least: int, times: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(places, length, period) of the runs over the boundary of each node, within the node.

    The longer side of such a run has half of its words and comes again one
    period away, so the words beside the boundary stand there again; their
    places are the candidates.
    """
    first, middle, end = (np.array([n[i] for n in nodes], np.int64) for i in range(3))
    gram = max(1, -(-least // 2) // 3)
    level = levels[gram.bit_length() - 1]  # windows no longer than those words
    width, n = 1 << (gram.bit_length() - 1), len(ids) + 1
    kinds = np.unique(level, return_inverse=True)[1].astype(np.int64)
    index = np.sort(kinds * n + np.arange(len(kinds)))
    for right in (True, False):
        here = middle if right else middle - width
        within = (here >= first) & (here + width <= end)
        which = np.flatnonzero(within)
        here, size = here[which], (end - middle if right else middle - first)[which]
        low, high = (here + 1, here + 2 * size // 3) if right else (here - 2 * size // 3, here - 1)
        a = np.searchsorted(index, kinds[here] * n + np.maximum(low, 0), "left")
        b = np.searchsorted(index, kinds[here] * n + np.maximum(high, -1), "right")
        found = np.maximum(b - a, 0)
        node = np.repeat(which, found)
        place = index[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(a, found)] % n
        period = place - np.repeat(here, found)
        m, p = middle[node], np.abs(period)
        one, other = np.minimum(m, m + period), np.maximum(m, m + period)
        after = _common(levels, one, other, end[node] - other, back=False)
        before = _common(levels, one, other, one - first[node], back=True)
        length = before + after + p
        good = np.flatnonzero(length >= np.maximum(least, times * p))
        start = one - before
        for i in good.tolist():
            at = nodes[node[i]]
            yield at[3] + (start[i] - at[0]), int(length[i]), int(p[i])


def _merged(found: Iterator[tuple[np.ndarray, int, int]]) -> list[Run]:
    """Maximal intervals of each period, then the smallest period of each interval."""
    rows = [np.stack([np.full(len(at), p), at, at + length], axis=1) for at, length, p in found]
    if not rows:
        return []
    rows = np.unique(np.concatenate(rows), axis=0)
    whole: dict[tuple[int, int], int] = {}
    current: list[int] | None = None
    for period, start, end in [*rows.tolist(), (0, 0, 0)]:
        if current and (period != current[0] or start > current[2] - period):
            span = current[1], current[2]
            whole[span] = min(current[0], whole.get(span, current[0]))
            current = None
        if current:
            current[2] = max(current[2], end)
        else:
            current = [period, start, end]
    return sorted((start, end - start, period) for (start, end), period in whole.items())


def runs_of(words: list[bytes], least: int = 24, times: int = 3) -> list[Run]:
    """(start, length, smallest period) of the maximal runs, by start and then period.

    Windows are compared by 64-bit hashes; each run found is compared word by word
    afterwards, and other hashes are taken if one does not hold.
    """
    if least < 6 or times < 3:
        raise ValueError("needs runs of six words and three periods at least")
    if not may_repeat(words, least):
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    nodes = [x for x in grammar(ids) if x[2] - x[0] >= least]
    seed = 0
    while True:
        runs = _merged(_crossing(nodes, ids, _windows(ids + 1, seed), least, times))
        if all(np.array_equal(ids[s : s + n - p], ids[s + p : s + n]) for s, n, p in runs):
            return runs
        seed += 1


def collapsed(words: list[bytes], runs: list[Run]) -> str:
    """The words joined by one space, without those behind the first period of a run."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words).decode()


def word_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(key, runs, collapsed) of every row of ``df``.

    Words are runs without ASCII white space. ``runs`` is an array of (start,
    length, period) of all stretches with smallest period ``period``, at least
    ``least`` words and ``times`` periods, that no neighbouring word extends;
    ``collapsed`` is the text with the first period of each run only.

    Null and empty texts have no words, no runs and an empty ``collapsed``; very
    long texts are taken whole, in memory that grows with n log n of one text;
    runs that start together are ordered by period; repeated rows and null keys
    give a row each; an empty table gives none; other columns of ``df`` play no
    part, whatever their names.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode().split() for t in batch["text"]]
            runs = [runs_of(words, least, times) for words in texts]
            spans = {name: [[run[i] for run in own] for own in runs] for i, name in enumerate(("start", "length", "period"))}
            kept = [collapsed(words, own) for words, own in zip(texts, runs)]
            yield pd.DataFrame({"id": batch["id"], **spans, "collapsed": kept})

    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    lists = "start array<bigint>, length array<bigint>, period array<bigint>"
    spans = F.arrays_zip("start", "length", "period").alias("runs")
    return rows.mapInPandas(found, f"id {kind}, {lists}, collapsed string").select(F.col("id").alias(key), spans, "collapsed")


def greatest(runs: Column) -> Column:
    """The run of the greatest length over period; of equal ones the first. Null without runs."""
    more = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, run: F.when(more(best, run), run).otherwise(best))


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of every row, with a repeated tail in rows whose key has a crc32 that ten divides.

    With h the crc32 of the key as text, g = floor(h / 10) and n words, each word
    i from a = g % n on becomes word a + (i - a) % p of the text, p = 1 +
    floor((n - a) / (3 + g % 8)). Null keys and texts without words stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = df.select(key, text, h.alias("h_"))
    chosen = (F.col("h_") % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    spread = rows.where(chosen).select(key, words.alias("words_"), F.floor(F.col("h_") / 10).alias("g_")).withColumn("n_", F.size("words_"))
    spread = spread.withColumn("a_", (F.col("g_") % F.col("n_")).cast("int"))
    spread = spread.withColumn("p_", 1 + F.floor((F.col("n_") - F.col("a_")) / (3 + F.col("g_") % 8)).cast("int"))
    tail = F.slice("words_", F.col("a_") + 1, F.col("p_"))
    times = F.ceil((F.col("n_") - F.col("a_")) / F.col("p_")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), F.col("n_") - F.col("a_"))
    whole = F.array_join(F.concat(F.slice("words_", F.lit(1), F.col("a_")), repeated), " ")
    return rows.where(~F.coalesce(chosen, F.lit(False))).select(key, text).unionByName(spread.select(key, whole.alias(text)))
