"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, mixing
from .decontaminate import leaks
from .exact_dedup import exact_dedup
from .prefix_counts import token_counts
from .quality import quality
from .repeats import greatest, planted, word_runs
from .secrets import secrets
from .simhash import simhash_components
from .token_files import tokenize_to_files
from .toxicity import toxicity
from .variants import spelling_variants
from .wrappers import main_text

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed through keyed state: see ``exact_dedup.exact_dedup``."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the trigrams of all others: see ``backoff.backoff_scores``."""
    scores = backoff.backoff_scores(table(spark, sf_dir, "documents"))
    rounded = {c: F.round(c, 6) for c in ("log_score", "mean_log_score")}
    return scores.withColumns(rounded)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item: see ``decontaminate.leaks``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, written to shard files and read back: see ``token_files.tokenize_to_files``."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokenize_to_files(table(spark, sf_dir, "documents"), tokenizer, "doc_id", "text", end_id=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored, rows with remainder 2 of 4 held out: see ``toxicity.toxicity``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored, rows with remainder 0 of 5 held out: see ``quality.quality``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: see ``mixing.mix``."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page by the wrapper of its host: see ``wrappers.main_text``."""
    return main_text(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and owner-specific opaque ones: see ``secrets.secrets``."""
    return secrets(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, three bits: see ``simhash.simhash_components``."""
    return simhash_components(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, max_bits=3)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole texts out of a stored table of all prefixes: see ``prefix_counts.token_counts``."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 24 words and three periods or more, with planted tails: see ``repeats.word_runs``."""
    found = word_runs(planted(table(spark, sf_dir, "documents")), least=24, times=3)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", greatest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words of whole texts and their most frequent forms: see ``variants.spelling_variants``."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_exact_dedup, op2_backoff_scores, op3_decontamination, op4_token_files, op5_toxicity, op6_quality_trees, op7_source_mixing, op8_html_wrappers, op9_secret_scan, op10_simhash_near_dedup, op11_token_counts, op12_periodic_runs, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op2_backoff_scores": backoff.SQL, "op7_source_mixing": mixing.SQL}
