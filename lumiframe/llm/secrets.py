"""Secret scans with ownership frequency over the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Kinds in their order; the first three are the fixed base, the last one is added by ownership.
KINDS = ("assign", "access", "hex", "opaque")
#: A value that so many owners hold is an example that was copied around.
EXAMPLE_OWNERS = 3
#: So is one that so many repositories hold, even those of one owner.
EXAMPLE_REPOSITORIES = 8
#: A live value is in so many repositories of its owner at most.
LIVE_REPOSITORIES = 3
#: Bits a character of a live-looking value at least.
LIVE_BITS = 3.0

# Fixed patterns of the base kinds, and the least length of the part that decides.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs [0-9a-f]+ that are long enough
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    counts = Counter(value)
    return -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())


def live_looking(value: str) -> bool:
    """Digits and letters in no obvious pattern."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and bits(value) >= LIVE_BITS


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, by start and then kind."""
    found = [
        (m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH
    ]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Live-looking runs with letters of both cases and digits, outside the base spans."""
    found = []
    for m in _OPAQUE.finditer(text):
        value = m[0]
        mixed = any(c.isdigit() for c in value) and not value.islower() and not value.isupper()
        if mixed and live_looking(value) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            found.append((m.start(), 3, m.end(), value))
    return found


def label(span: tuple[int, int, int, str]) -> str:
    return f"{KINDS[span[1]]}:{span[0]}:{span[2]}"


_CANDIDATES = "array<struct<start: int, kind: int, label: string, value: string, live: boolean>>"


def scan(df: DataFrame, key: str, text: str, owner: Column, repository: Column) -> DataFrame:
    """Per row: id, owner, repository, base counts and digest, and candidates (values as SHA-256)."""
    docs = df.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
    )

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                base = base_spans(t)
                kinds = [k for _, k, _, _ in base]
                digest = hashlib.sha256(",".join(map(label, base)).encode()).hexdigest()
                candidates = [
                    (s[0], s[1], label(s), hashlib.sha256(s[3].encode()).hexdigest(), live_looking(s[3]))
                    for s in [*base, *opaque_spans(t, base)]
                ]
                rows.append((*(kinds.count(k) for k in range(3)), digest, candidates))
            found = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "candidates"])
            yield pd.concat([batch[["id", "owner", "repository"]].reset_index(drop=True), found], axis=1)

    schema = f"id {df.schema[key].dataType.simpleString()}, owner string, repository string, "
    schema += f"n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, candidates {_CANDIDATES}"
    return docs.mapInPandas(scanned, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, owners, repositories, verdict) of each candidate hash.

    Owners and repositories are each counted once. ``EXAMPLE_OWNERS`` or
    ``EXAMPLE_REPOSITORIES`` make a value an example; one owner with
    ``LIVE_REPOSITORIES`` at most makes it live where it looks random; what lies
    between, such as a value that its owner has put everywhere, is unclear. Rows of
    one (value, repository, owner) collapse before and after the shuffle, so a
    value copied into a third of all documents is a few rows.
    """
    seen = candidates.groupBy("value", "repository", "owner").agg(F.bool_or("live").alias("live"))
    counted = seen.groupBy("value").agg(
        F.count_distinct(F.coalesce("owner", F.lit(""))).alias("owners"),
        F.count_distinct(F.coalesce("repository", F.lit(""))).alias("repositories"),
        F.bool_or("live").alias("live"),
    )
    owners, repositories = F.col("owners"), F.col("repositories")
    example = (owners >= EXAMPLE_OWNERS) | (repositories >= EXAMPLE_REPOSITORIES)
    verdict = F.when(example, "example").when(
        (owners == 1) & (repositories <= LIVE_REPOSITORIES) & F.col("live"), "live"
    )
    return counted.withColumn("verdict", verdict.otherwise("unclear"))


def _judged(df: DataFrame, key: str, text: str, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(df.sparkSession, "secrets")
    # The row number is written with the row, so later reads agree on it.
    rows = scan(df, key, text, owner, repository).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.table(rows, "scan")
    single = rows.where(F.size("candidates") > 0)
    single = single.select("row", "id", "owner", "repository", F.explode("candidates").alias("c"))
    single = single.select("row", "id", "owner", "repository", "c.*")
    verdicts = scratch.table(ownership(single), "verdicts")
    return rows, single.join(verdicts.drop("live"), "value")


def secret_findings(
    df: DataFrame, key: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None
) -> DataFrame:
    """One row a candidate: (key, kind, span, value_sha256, owners, repositories, verdict). See ``secrets``."""
    owner, repository = _places(owner, repository)
    _, judged = _judged(df, key, text, owner, repository)
    names = F.array(*[F.lit(k) for k in KINDS])
    return judged.select(
        F.col("id").alias(key),
        F.element_at(names, F.col("kind") + 1).alias("kind"),
        F.col("label").alias("span"),
        F.col("value").alias("value_sha256"),
        "owners",
        "repositories",
        "verdict",
    )


def _places(owner: Column | None, repository: Column | None) -> tuple[Column, Column]:
    owner = F.col("source") if owner is None else owner
    return owner, F.concat_ws("/", "source", "lang") if repository is None else repository


def secrets(
    df: DataFrame, key: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None
) -> DataFrame:
    """Per row of ``df``: key, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live.

    Every base span stays. A value is an example when ``EXAMPLE_OWNERS`` owners or
    ``EXAMPLE_REPOSITORIES`` repositories or more hold it anywhere in the corpus,
    and live when it looks random and one owner alone holds it, in
    ``LIVE_REPOSITORIES`` repositories at most and however many documents. Opaque
    runs are added to the spans where they are live. A span is the whole match in
    code points, end exclusive.

    The owner is the column ``source`` and the repository source and language,
    unless given. A null owner or repository is one without a name. Null and empty
    texts have no spans and very long ones are scanned whole, a match as long as it
    is; null and repeated keys and repeated rows are each scanned; an
    empty table gives no rows; other columns play no part, whatever their names.
    """
    owner, repository = _places(owner, repository)
    rows, judged = _judged(df, key, text, owner, repository)
    added = F.when((F.col("kind") == 3) & (F.col("verdict") == "live"), F.struct("start", "kind", "label"))
    extra = judged.groupBy("row").agg(
        F.collect_list(added).alias("added"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
    )
    base = F.filter("candidates", lambda c: c["kind"] < 3)
    base = F.transform(base, lambda c: F.struct(c["start"], c["kind"], c["label"]))
    none = F.array().cast("array<struct<start: int, kind: int, label: string>>")
    spans = F.array_sort(F.concat(base, F.coalesce("added", none)))
    return rows.join(extra, "row", "left").select(
        F.col("id").alias(key),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_join(F.transform(spans, lambda s: s["label"]), ",").alias("spans"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )
