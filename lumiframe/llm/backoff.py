"""Stupid-backoff scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ORDER, DISCOUNT = 3, 0.4
#: Bits of an n-gram's hash. Among n different n-grams a share of n / 2**56 meets another one.
KEY_BITS = 56
#: Tokens of a block of documents, and n-grams of one part of the count tables, at which the next one begins.
BLOCK_TOKENS, PART_ENTRIES = 2_000_000, 2_000_000


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_hashes(vocabulary: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in vocabulary], dtype=np.uint64)


def gram_keys(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of the last word) of every n-gram that lies inside one document."""
    inside = np.ones(len(hashes), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    for i in range(n - 1):
        begin = starts[lengths > i] + i
        inside[begin] = False
    last = np.flatnonzero(inside).astype(np.int32)
    key = np.full(len(last), n, np.uint64)
    for i in range(n - 1, -1, -1):
        key = (key ^ hashes[last - i]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return (key * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - KEY_BITS), last


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed planes of their bytes, lowest first."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def token_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of documents: ids, document lengths, vocabulary hashes and tokens as places in the vocabulary."""

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        tokens: list[np.ndarray] = []
        known: dict[str, int] = {}
        size = number = 0

        def block() -> pd.DataFrame:
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            return pd.DataFrame(
                {
                    "block": [(TaskContext.get().partitionId() << 24) | number],
                    "ids": [ids],
                    "n_tokens": [len(flat)],
                    "lengths": [pack_numbers(np.array([len(t) for t in tokens], np.uint64))],
                    "vocabulary": [word_hashes(list(known)).tobytes()],
                    "tokens": [pack_numbers(flat)],
                }
            )

        for batch in batches:
            for i, t in zip(batch["id"], batch["text"]):
                place = known.setdefault
                own = np.array([place(w, len(known)) for w in words(t)], dtype=np.int32)
                ids.append(i)
                tokens.append(own)
                size += len(own)
                if size >= BLOCK_TOKENS:
                    yield block()
                    ids, tokens, known, size, number = [], [], {}, 0, number + 1
        if ids:
            yield block()

    docs = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    schema = "block bigint, ids array<string>, n_tokens bigint, lengths binary, vocabulary binary, tokens binary"
    return docs.mapInPandas(blocked, schema)


class Grams:
    """Tokens of one block and its n-grams of one order, each different one once and in order of its key."""

    def __init__(self, row):
        self.lengths = unpack_numbers(row["lengths"]).astype(np.int64)
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        tokens = unpack_numbers(row["tokens"])
        self.hashes = vocabulary[tokens.astype(np.int32)] if len(tokens) else np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different keys, place among them of each n-gram, place of its last word)."""
        keys, last = gram_keys(self.hashes, self.lengths, n)
        different, place = np.unique(keys, return_inverse=True)
        return different, place.astype(np.int32), last


def explode_grams(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """(part, n, block, keys, counts): a block's different n-grams by the leading ``bits`` of their hash.

    Equal n-grams of a block are one entry with their count, so a very frequent
    n-gram is one entry a block and no hot key.
    """

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                grams = Grams(row)
                for n in range(1, order + 1):
                    keys, place, _ = grams.of(n)
                    counts = np.bincount(place, minlength=len(keys)).astype(np.uint64)
                    parts = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
                    found, first = np.unique(parts, return_index=True)
                    ends = [*first[1:].tolist(), len(keys)]
                    spans = list(zip(first.tolist(), ends))
                    yield pd.DataFrame(
                        {
                            "part": found,
                            "n": np.full(len(found), n, np.int32),
                            "block": np.full(len(found), row["block"]),
                            "keys": [pack_sorted(keys[a:b]) for a, b in spans],
                            "counts": [pack_numbers(counts[a:b]) for a, b in spans],
                        }
                    )

    return blocks.mapInPandas(exploded, "part bigint, n int, block bigint, keys binary, counts binary")


def join_counts(grams: DataFrame) -> DataFrame:
    """(block, part, n, counts): corpus counts of the blocks' n-grams, in the order of their keys.

    A group is one part of one count table, its n-grams come from all blocks; it is
    summed by key and joined back to the rows it came from.
    """

    def counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in rows["keys"]]
        counts = np.concatenate([unpack_numbers(c) for c in rows["counts"]]).astype(np.int64)
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts, len(different)).astype(np.uint64)[place]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame(
            {"block": rows["block"], "part": key[0], "n": key[1], "counts": [pack_numbers(c) for c in np.split(total, cuts)]}
        )

    return grams.groupBy("part", "n").applyInPandas(counted, "block bigint, part bigint, n int, counts binary")


def score_block(row, totals: dict[int, np.ndarray], order: int, discount: float, n_all: int, own: bool) -> pd.DataFrame:
    """Scores of a block's documents from the corpus counts of its n-grams, in key order by n."""
    grams = Grams(row)
    lengths = grams.lengths
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    n_tokens = len(owner)
    others = np.maximum(n_all - (0 if own else lengths[owner]), 1).astype(float)
    score = np.zeros(n_tokens)
    below = others  # count of the context
    for n in range(1, order + 1):
        keys, place, last = grams.of(n)
        total = totals[n][place].astype(np.int64) if len(place) else np.zeros(0, np.int64)
        if not own and len(place):
            # What the document itself holds of an n-gram does not count for it.
            pair = place.astype(np.int64) * len(lengths) + owner[last]
            _, at, repeats = np.unique(pair, return_inverse=True, return_counts=True)
            total -= repeats[at]
            del pair, at, repeats
        count = np.zeros(n_tokens)
        count[last] = total
        del keys, place, total
        if n == 1:
            seen = np.maximum(count, 0)
            score = np.log(np.where(seen > 0, seen, 0.5) / others)
        else:
            inside = np.zeros(n_tokens, bool)
            inside[last] = True
            context = np.concatenate(([0.0], below[:-1]))
            score = np.where(inside, score + math.log(discount), score)
            found = inside & (count > 0) & (context > 0)
            score[found] = np.log(count[found] / context[found])
        below = count
    sums = np.bincount(owner, score, len(lengths)) if n_tokens else np.zeros(len(lengths))
    return pd.DataFrame({"id": list(row["ids"]), "n_tokens": lengths, "log_score": sums})


def backoff_scores(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    discount: float = DISCOUNT,
    own: bool = False,
) -> DataFrame:
    """(key, n_tokens, log_score, mean_log_score) of every row of ``df``.

    A word's score is the count of the longest n-gram that ends in it over the
    count of that n-gram's context, ``discount`` for each word the n-gram is
    shorter than it could be; a single word's is its count over all words, half a
    count if there is none. ``log_score`` sums the logarithms over the document.
    Counts come from the whole table, but for what the document itself holds
    unless ``own`` is set: otherwise nothing would ever back off. Words are
    lower-cased runs without white space.

    A null or empty text has no words and scores zero with a null mean; null and
    repeated keys and repeated rows are each scored, and copies count for each
    other; an empty table gives no rows; other columns play no part, whatever
    their names. The key comes back in its own type.
    """
    scratch = Scratch(df.sparkSession, "backoff")
    blocks = scratch.table(token_blocks(df, key, text), "blocks")
    n_all = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, n_all / PART_ENTRIES))))
    counts = scratch.table(join_counts(explode_grams(blocks, order, bits)), "counts")

    def scored(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["n", "part"])
        totals = {
            n: np.concatenate([np.zeros(0, np.uint64), *map(unpack_numbers, found["counts"][found["n"] == n])])
            for n in range(1, order + 1)
        }
        return score_block(rows.iloc[0], totals, order, discount, n_all, own)

    scores = blocks.groupBy("block").cogroup(counts.groupBy("block"))
    scores = scratch.table(scores.applyInPandas(scored, "id string, n_tokens bigint, log_score double"), "scores")
    scratch.drop("blocks", "counts")
    return scores.select(
        F.col("id").cast(df.schema[key].dataType).alias(key),
        "n_tokens",
        "log_score",
        F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"),
    )


#: The same scores in SQL for trigrams, rounded to six digits.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
split AS (
  SELECT r, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS ws FROM docs
),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split),
grams AS (
  SELECT r, pos, w AS g1, lag(w) OVER p || ' ' || w AS g2, lag(w, 2) OVER p || ' ' || lag(w) OVER p || ' ' || w AS g3
  FROM words WINDOW p AS (PARTITION BY r ORDER BY pos)
),
counted AS (
  SELECT r, pos, g2 IS NOT NULL AS has2, g3 IS NOT NULL AS has3,
         count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY r, g1) AS n1,
         count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY r, g2) AS n2,
         count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY r, g3) AS n3,
         greatest(count(*) OVER () - count(*) OVER (PARTITION BY r), 1) AS others
  FROM grams
),
placed AS (
  SELECT *, lag(n1) OVER p AS below1, lag(n2) OVER p AS below2 FROM counted WINDOW p AS (PARTITION BY r ORDER BY pos)
),
scored AS (
  SELECT r, CASE
    WHEN has3 AND n3 > 0 AND below2 > 0 THEN ln(n3 / below2)
    WHEN has2 AND n2 > 0 AND below1 > 0 THEN ln(n2 / below1) + CASE WHEN has3 THEN ln({DISCOUNT}) ELSE 0 END
    ELSE ln(CASE WHEN n1 > 0 THEN n1 ELSE 0.5 END / others) + (least(pos, 3) - 1) * ln({DISCOUNT})
  END AS score FROM placed
),
sums AS (SELECT r, count(*) AS n, sum(score) AS total FROM scored GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(coalesce(total, 0.0), 6)::DOUBLE AS log_score,
       round(total / n, 6)::DOUBLE AS mean_log_score
FROM docs LEFT JOIN sums USING (r)
"""
