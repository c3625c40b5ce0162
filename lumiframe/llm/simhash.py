"""SimHash near-duplicates whose candidates pass a pigeonring chain filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import Scratch, shuffle_partitions

BITS = 64
SEED = 42
#: Rows of one bucket that are compared together; larger buckets are cut into parts.
BUCKET_ROWS = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; no words give zero.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer
    words than a shingle counts as one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:] - 1
    first = np.concatenate(([0], ends[: n - 1]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())], dtype="<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint bigint) of every row of ``df``."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fingerprint": found.view(np.int64)})

    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("fingerprint", T.LongType())])
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(hashed, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ``max_bits + 1`` segments of a fingerprint, lowest first."""
    m = max_bits + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(prints: np.ndarray, segment: tuple[int, int]) -> np.ndarray:
    shift, width = segment
    return (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def chain_keys(prints: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(chain start, keys, rows of ``prints``, whether they are probes) for the chain prefixes.

    Two fingerprints at ``max_bits`` or fewer differing bits have a start on the
    ring of segments from which l consecutive segments differ in at most
    l * max_bits / (max_bits + 1) bits, for every l. So the first segment is equal
    and the second differs in one bit at most. The key holds both segments; of
    two that differ in one bit exactly one has an even number of ones, and only
    that one probes with each bit of its second segment turned.
    """
    parts = segments(max_bits)
    for i, first in enumerate(parts):
        second = parts[(i + 1) % len(parts)]
        head = _part(prints, first) << np.uint64(second[1])
        tail = _part(prints, second)
        yield i, head | tail, np.arange(len(prints)), False
        even = np.flatnonzero(np.bitwise_count(tail) % 2 == 0)
        for bit in range(second[1]):
            yield i, head[even] | (tail[even] ^ np.uint64(1 << bit)), even, True


def _within(one: np.uint64, others: np.ndarray, start: int, max_bits: int) -> np.ndarray:
    """Chain budgets from ``start``, shortest chain first, and then the full distance."""
    apart = others ^ one
    parts = segments(max_bits)
    spent, keep = np.zeros(len(others), np.int64), np.ones(len(others), bool)
    for l in range(1, len(parts)):
        spent += np.bitwise_count(_part(apart, parts[(start + l - 1) % len(parts)]))
        keep &= spent <= l * max_bits // len(parts)
    return keep & (np.bitwise_count(apart) <= max_bits)


def bucket_stars(prints: np.ndarray, probes: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges from each member to the first member of its component inside one bucket.

    A probe is compared with rows that own the key, not with other probes. At
    most as many edges as members leave, however many pairs are linked.
    """
    edges: list[tuple[int, int]] = []
    waiting = np.arange(len(prints))
    while len(waiting):
        root, waiting = waiting[0], waiting[1:]
        frontier = [root]
        while frontier and len(waiting):
            at = frontier.pop()
            linked = _within(prints[at], prints[waiting], start, max_bits)
            if probes[at]:
                linked &= ~probes[waiting]
            found, waiting = waiting[linked], waiting[~linked]
            edges += [(int(prints[x]), int(prints[root])) for x in found]
            frontier += found.tolist()
    return edges


def _runs(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Batches cut so that rows of one key stay together; the input is sorted by ``names``."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[names].iloc[-1]
        same = np.logical_and.reduce([batch[n].to_numpy() == last[n] for n in names])
        if not same.all():
            yield pd.concat([*rest, batch[~same]])
            rest = [batch[same]]
        else:
            if rest and (rest[-1][names].iloc[-1] != last).any():
                yield pd.concat(rest)
                rest = []
            rest.append(batch)
    if rest:
        yield pd.concat(rest)


def candidate_stars(buckets: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) inside each bucket of rows sorted by (start, key, a, b)."""
    names = ["start", "key", "a", "b"]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches, names):
            keys = rows[names].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
            prints, probes = rows["fingerprint"].to_numpy().view(np.uint64), rows["probe"].to_numpy()
            edges: list[tuple[int, int]] = []
            for a, b in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
                if not probes[a:b].all():
                    edges += bucket_stars(prints[a:b], probes[a:b], int(keys[a, 0]), max_bits)
            found = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return buckets.mapInPandas(linked, "u bigint, v bigint")


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges that connect exactly the fingerprints (bigint, distinct) that chains of links connect."""
    spark = prints.sparkSession

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fingerprint"].to_numpy().view(np.uint64)
            for start, keys, rows, probe in chain_keys(own, max_bits):
                yield pd.DataFrame(
                    {
                        "start": np.full(len(keys), start, np.int32),
                        "key": keys.view(np.int64),
                        "fingerprint": own[rows].view(np.int64),
                        "probe": np.full(len(keys), probe),
                    }
                )

    rows = prints.mapInPandas(keyed, "start int, key bigint, fingerprint bigint, probe boolean")
    counts = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n"), F.bool_and("probe").alias("idle"))
    counts = counts.where("n > 1 and not idle")
    # Only buckets with a partner come back; a large one is cut into parts, each pair of parts a bucket of its own.
    # Spark sizes the keys by the table they were made from, a small part of them, and would send all buckets through
    # the driver; adaptive execution keeps such a join, as another one has more shuffles.
    parts = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", "probe"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    shared = (
        rows.join(counts.select("start", "key", parts.alias("parts")).hint("merge"), ["start", "key"])
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("a", F.least("own", "other"))
        .withColumn("b", F.greatest("own", "other"))
        .select("start", "key", "a", "b", "fingerprint", "probe")
        .repartition(shuffle_partitions(spark), "start", "key", "a", "b")
        .sortWithinPartitions("start", "key", "a", "b", "probe")
    )
    return candidate_stars(shared, max_bits)


def simhash_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``df``.

    Rows whose fingerprints differ in ``max_bits`` bits or fewer are linked;
    ``component_id`` is the smallest key reachable over links. ``fingerprint`` is
    16 lower-case hexadecimal digits. A null or empty text has fingerprint zero
    and is linked like any other; rows with a null key take part and have the
    component's smallest key (null when there is none); repeated keys and rows
    are kept, one result row each; an empty table gives no rows; other columns
    of ``df`` play no part, whatever their names.

    Equal fingerprints collapse before anything is compared, so a group of copies
    is one node however large it is.
    """
    prints, labelled = _labelled(df, key, text, shingle, max_bits)
    # Copies may be a third of all rows; the side with one row for each fingerprint lets Spark split their key.
    return prints.join(labelled, "fingerprint").select(
        F.col("id").alias(key),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def _labelled(df: DataFrame, key: str, text: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, fingerprint) of each row, and (fingerprint, root, first) of each fingerprint.

    ``root`` is one fingerprint for all that links connect, ``first`` their smallest key.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be in 0..7")
    scratch = Scratch(df.sparkSession, "simhash")
    prints = scratch.table(fingerprints(df, key, text, shingle), "prints")
    distinct = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    if not max_bits:
        return prints, distinct.withColumn("root", F.col("fingerprint"))
    distinct = scratch.table(distinct, "distinct")
    edges = scratch.table(links(distinct.select("fingerprint"), max_bits), "links")
    roots = components(edges, scratch)
    joined = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left")
    rooted = joined.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    labelled = scratch.table(rooted.drop("first").join(least, "root"), "labelled")
    scratch.drop("links", "distinct")
    return prints, labelled


def one_of_each(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """One row of each group that ``simhash_components`` links, with all columns of ``df``.

    The row with the smallest key stays; a null key only where its group has no
    other. Of rows with the same key one with the smallest fingerprint of the
    group stays, and only one. Only keys and fingerprints are joined; texts move
    only where a key is null or repeated.
    """
    prints, labelled = _labelled(df, key, text, shingle, max_bits)
    chosen = F.struct(F.col("id").isNull().alias("last"), "id", "fingerprint")
    stays = prints.join(labelled, "fingerprint").groupBy("root").agg(F.min(chosen).alias("c")).select("c.id", "c.fingerprint")
    scratch = Scratch(df.sparkSession, "simhash")
    stays = scratch.table(stays, "stays")
    several = prints.groupBy("id").count().where("id is null or count > 1").select("id")
    several = scratch.table(several, "several")
    gone = prints.join(stays, ["id", "fingerprint"], "left_anti").select("id").distinct()
    gone = scratch.table(gone.unionByName(several).distinct(), "gone")
    single = df.join(gone.select(F.col("id").alias("gone_")), F.col(key).eqNullSafe(F.col("gone_")), "left_anti")
    if not several.take(1):
        return single
    whole = df.select(F.struct(*df.columns).alias("row"))
    repeated = whole.join(several, F.col("row")[key].eqNullSafe(F.col("id")), "left_semi")

    @F.pandas_udf("bigint")
    def printed(batch: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    repeated = repeated.withColumn("fingerprint", printed(F.col("row")[text])).withColumn("id", F.col("row")[key])
    same = repeated["id"].eqNullSafe(stays["id"]) & (repeated["fingerprint"] == stays["fingerprint"])
    repeated = repeated.join(stays, same, "left_semi").groupBy("id", "fingerprint").agg(F.min("row").alias("row"))
    return single.unionByName(repeated.select("row.*"))
