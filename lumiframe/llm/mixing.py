"""Temperature mixing of sources, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from .scratch import Scratch

#: Entropy wanted, as a share of the largest one (equal weights), and passes over a source at most.
ENTROPY, REPETITION = 0.95, 2.0
#: Blocks of a source at least, and tokens of a block in sources with more.
BLOCKS, BLOCK_TOKENS = 128, 1_000_000
SEED = 42
#: Halvings of the exponent's interval, and how many of them one job answers.
HALVINGS, AHEAD = 50, 5


def token_count(text: Column) -> Column:
    """Runs without spaces, tabs and line ends."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("bigint")


def source_key(source: Column) -> Column:
    """Text that keeps a null source apart from every named one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of share^a, sum of share^a * ln share) for each exponent a, in one job."""
    power = [F.pow("share", F.lit(a)) for a in exponents]
    row = shares.agg(*[F.sum(p) for p in power], *[F.sum(p * F.ln("share")) for p in power]).first()
    return list(zip(row[: len(power)], row[len(power) :]))


def _halve(shares: DataFrame, holds, keep_high: bool) -> float:
    """End of [0, 1] at which ``holds`` changes, by bisection.

    Five halvings need at most 31 different midpoints; one job evaluates them all.
    """
    low, high = 0.0, 1.0
    for _ in range(HALVINGS // AHEAD):
        parts = 1 << AHEAD
        points = [low + (high - low) * i / parts for i in range(1, parts)]
        known = dict(zip(points, _sums(shares, points)))
        for _ in range(AHEAD):
            middle = (low + high) / 2
            if holds(middle, *known[middle]) == keep_high:
                high = middle
            else:
                low = middle
    return high if keep_high else low


def exponent(shares: DataFrame, entropy: float, repetition: float, budget_share: float) -> float:
    """Exponent of the source shares (column ``share``, all above zero).

    The largest that reaches the entropy, raised where a source would otherwise be
    repeated more often than ``repetition`` times. One, the corpus as it is, when
    no exponent keeps the limit.
    """
    least, count = shares.agg(F.min("share"), F.count("share")).first()

    def spread(a: float, total: float, logs: float) -> bool:
        return math.log(total) - a * logs / total >= entropy * math.log(count)

    def kept(a: float, total: float, logs: float) -> bool:
        return least ** (a - 1) / total * budget_share <= repetition

    ends = dict(zip((0.0, 1.0), _sums(shares, [0.0, 1.0])))
    wide = 1.0 if spread(1.0, *ends[1.0]) else _halve(shares, spread, False)
    if kept(0.0, *ends[0.0]):
        return wide
    limited = _halve(shares, kept, True) if kept(1.0, *ends[1.0]) else 1.0
    return max(wide, limited)


def plan_blocks(
    measured: DataFrame,
    scratch: Scratch,
    entropy: float = ENTROPY,
    repetition: float = REPETITION,
    budget: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(s, parts, block, epoch, position) of every block that the mix takes.

    ``measured`` has s (source key), id and tokens. A source's documents fall into
    blocks by a hash of their id. In each epoch a source's blocks are permuted by
    another hash; full epochs take all of them, the last one takes blocks until the
    source's budget is met as nearly as whole blocks allow. ``position`` is the
    share of the source's budget before the block: in its order the sources
    are mixed at their weights from the first document to the last. A source
    without any token has no weight, and its documents are taken once, first.
    """
    sums = measured.groupBy("s").agg(F.sum("tokens").alias("n"))
    sums = scratch.table(sums, "sources")
    total = sums.agg(F.sum("n")).first()[0] or 0
    budget = total if budget is None else budget
    parts = F.greatest(F.lit(BLOCKS), F.ceil(F.col("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("parts")
    if total:
        shares = sums.where("n > 0").select("s", "n", (F.col("n") / F.lit(float(total))).alias("share"))
        a = exponent(shares, entropy, repetition, budget / total)
        whole = _sums(shares, [a])[0][0]
        wanted = F.floor(F.pow("share", F.lit(a)) / F.lit(whole) * F.lit(float(budget)))
        wanted = F.when(F.lit(a == 1.0 and budget == total), F.col("n")).otherwise(wanted)
        weighted = shares.select("s", "n", wanted.cast("bigint").alias("wanted"))
    else:
        weighted = sums.where("n > 0").select("s", "n", F.col("n").alias("wanted"))
    rows = weighted.unionByName(sums.where("n = 0").select("s", "n", F.lit(0).cast("bigint").alias("wanted")))
    rows = scratch.table(rows.select("s", "n", "wanted", parts), "weights")
    blocks = measured.join(rows.select("s", "parts"), "s")
    blocks = blocks.groupBy("s", block_of(seed).alias("block")).agg(F.sum("tokens").alias("tokens"))
    full = F.when(F.col("n") > 0, F.floor(F.col("wanted") / F.greatest("n", F.lit(1)))).otherwise(F.lit(0))
    epochs = (
        blocks.join(rows, "s")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), full.cast("int"))))
        .withColumn("turn", hash32(seed, "turn", F.col("s"), F.col("epoch"), F.col("block")))
    )
    # One row a block here, not a document: a source with a third of all rows has a third of the blocks.
    before = "coalesce(sum(tokens) OVER (PARTITION BY s, epoch ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    placed = epochs.withColumn("before", F.expr(f"epoch * n + {before}"))
    taken = placed.where("n = 0 or (epoch * n < wanted and 2 * before + tokens <= 2 * wanted)")
    position = F.when(F.col("wanted") > 0, F.col("before") / F.col("wanted")).otherwise(F.lit(0.0))
    return taken.select("s", "parts", "block", "epoch", position.alias("position"))


def block_of(seed: int = SEED) -> Column:
    """Block of a document from the columns s, id and parts."""
    return F.pmod(hash32(seed, "block", F.col("s"), F.col("id")), F.col("parts")).cast("int")


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    entropy: float = ENTROPY,
    repetition: float = REPETITION,
    budget: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(key, source, n_tokens, epoch, block, position): each document as often as the mix takes it.

    The budget is the tokens of the table unless given. A null source is a source
    of its own; null and empty texts have no tokens and go with their block; null
    keys fall into one block of their source; repeated rows and keys are all
    taken, together, as they share a block; an empty table gives no rows; other
    columns play no part, whatever their names.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    own, named = F.col(source), F.col(key)
    measured = df.select(
        source_key(own).alias("s"), named.alias("id"), token_count(F.col(text)).alias("tokens"), own.alias("source")
    )
    measured = scratch.table(measured, "measured")
    plan = scratch.table(plan_blocks(measured, scratch, entropy, repetition, budget, seed), "plan")
    parts = scratch.read("weights", _weights()).select("s", "parts")
    return (
        measured.join(parts, "s")
        .withColumn("block", block_of(seed))
        .join(plan.drop("parts"), ["s", "block"])
        .select(
            F.col("id").alias(key),
            F.col("source").alias(source),
            F.col("tokens").alias("n_tokens"),
            "epoch",
            "block",
            "position",
        )
    )


def mixed_rows(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The rows of ``df``, with its columns, each as often as ``mix`` takes it."""
    scratch = Scratch(df.sparkSession, "mixing")
    measured = df.select(
        source_key(F.col(source)).alias("s"), F.col(key).alias("id"), token_count(F.col(text)).alias("tokens")
    )
    measured = scratch.table(measured, "measured")
    seed = options.get("seed", SEED)
    plan = scratch.table(plan_blocks(measured, scratch, **options), "plan")
    parts = scratch.read("weights", _weights()).select("s", "parts")
    scratch.drop("measured")
    whole = df.select(F.struct(*df.columns).alias("row"))
    whole = whole.select("row", source_key(F.col("row")[source]).alias("s"), F.col("row")[key].alias("id"))
    taken = whole.join(parts, "s").withColumn("block", block_of(seed)).join(plan.select("s", "block"), ["s", "block"])
    return taken.select(*[F.col("row")[c].alias(c) for c in df.columns])


def _weights() -> str:
    return "s string, n bigint, wanted bigint, parts int"


#: The same rows in SQL, with the settings above.
SQL = f"""
WITH RECURSIVE measured AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens
  FROM documents
),
sources AS (SELECT s, sum(tokens)::BIGINT AS n FROM measured GROUP BY s),
shares AS (
  SELECT s, n, n::DOUBLE / (SELECT sum(n) FROM sources)::DOUBLE AS share FROM sources WHERE n > 0
),
facts AS (SELECT min(share) AS least, count(*) AS k, (SELECT sum(n) FROM sources)::DOUBLE AS total FROM shares),
wide(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
  FROM (
    SELECT step, low, high, ln(z) - (low + high) / 2 * l / z >= {ENTROPY} * ln((SELECT k FROM facts)) AS ok
    FROM (
      SELECT step, low, high, sum(pow(share, (low + high) / 2)) AS z,
             sum(pow(share, (low + high) / 2) * ln(share)) AS l
      FROM wide, shares WHERE step < {HALVINGS} GROUP BY ALL
    )
  )
),
limited(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (
    SELECT step, low, high, pow((SELECT least FROM facts), (low + high) / 2 - 1) / z <= {REPETITION} AS ok
    FROM (
      SELECT step, low, high, sum(pow(share, (low + high) / 2)) AS z
      FROM limited, shares WHERE step < {HALVINGS} GROUP BY ALL
    )
  )
),
chosen AS (
  SELECT greatest(
    CASE WHEN (SELECT -sum(share * ln(share)) FROM shares) >= {ENTROPY} * ln(k) THEN 1.0
         ELSE (SELECT max(low) FROM wide WHERE step = {HALVINGS}) END,
    CASE WHEN pow(least, -1) / k <= {REPETITION} THEN 0.0
         ELSE (SELECT max(high) FROM limited WHERE step = {HALVINGS}) END
  ) AS a, total FROM facts
),
weights AS (
  SELECT s, n, CASE WHEN n = 0 THEN 0 WHEN a = 1 THEN n
                    ELSE floor(pow(n / total, a) / (SELECT sum(pow(share, a)) FROM shares) * total)::BIGINT END AS wanted,
         greatest({BLOCKS}, ceil(n / {BLOCK_TOKENS}))::BIGINT AS parts
  FROM sources, chosen
),
placed AS (
  SELECT m.*, n, wanted,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', 'block', m.s, m.doc_id::VARCHAR)), 1, 8))::BIGINT % parts AS block
  FROM measured m JOIN weights USING (s)
),
blocks AS (SELECT s, block, n, wanted, sum(tokens)::BIGINT AS tokens FROM placed GROUP BY ALL),
epochs AS (
  SELECT s, block, n, wanted, tokens, epoch,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', 'turn', s, epoch::VARCHAR, block::VARCHAR)), 1, 8))::BIGINT AS turn
  FROM blocks, LATERAL (SELECT unnest(range(0, CASE WHEN n > 0 THEN wanted // n ELSE 0 END + 1)) AS epoch)
),
taken AS (
  SELECT s, block, epoch, n, wanted, tokens,
         epoch * n + coalesce(sum(tokens) OVER (PARTITION BY s, epoch ORDER BY turn, block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM epochs
)
SELECT p.doc_id, p.source, p.tokens AS n_tokens, t.epoch::INT AS epoch, p.block::INT AS block,
       CASE WHEN t.wanted > 0 THEN t.ahead::DOUBLE / t.wanted::DOUBLE ELSE 0.0 END AS position
FROM placed p JOIN taken t ON p.s = t.s AND p.block = t.block
WHERE t.n = 0 OR (t.epoch * t.n < t.wanted AND 2 * t.ahead + t.tokens <= 2 * t.wanted)
"""
