"""Experiment tables: arg-best rows, leaderboards, roll-ups, trial summaries, logs.

Rows are picked with ``row_number() <= n``, which Spark limits per task before
the shuffle, so a group with most of the rows sends n rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAIN_METRIC
from .ordering import competition_rank, running


def _direction(metric: str, best_is_max: bool) -> Column:
    return F.desc(metric) if best_is_max else F.asc(metric)


def _scored(df: DataFrame, metric: str) -> DataFrame:
    return df.where(F.col(metric).isNotNull() & ~F.isnan(metric))


def top_rows(
    df: DataFrame,
    metric: str,
    n: int,
    tie: Sequence[Column | str],
    by: Sequence[str] = (),
    best_is_max: bool = True,
) -> DataFrame:
    """The ``n`` best rows per group; rows without the metric never count."""
    rows = _scored(df, metric)
    order = [_direction(metric, best_is_max), *tie]
    if not by:
        return rows.orderBy(*order).limit(n)
    place = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place_", F.row_number().over(place)).where(F.col("place_") <= n).drop("place_")


def best_row(
    df: DataFrame,
    metric: str = MAIN_METRIC,
    best_is_max: bool = True,
    tie: Sequence[Column | str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """The best row (per group); ``tie`` decides among equals."""
    return top_rows(df, metric, 1, tie, by, best_is_max)


def leaderboard(df: DataFrame, metric: str, by: Sequence[str], best_is_max: bool = True) -> DataFrame:
    best = F.max(metric) if best_is_max else F.min(metric)
    return _scored(df, metric).groupBy(*by).agg(best.alias(metric))


def children(runs: DataFrame, parent: str) -> DataFrame:
    return runs.where(F.col("parent_run_id") == parent)


def with_parent(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each child with ``columns`` of its parent as ``parent_<column>``.

    Parents are unique, so the join never multiplies rows; a parent with very many
    children is split by adaptive execution.
    """
    parents = runs.select(
        F.col("run_id").alias("parent_key"), *[F.col(c).alias(f"parent_{c}") for c in columns if c != "run_id"]
    )
    return runs.join(parents, F.col("parent_run_id") == F.col("parent_key")).drop("parent_key")


def roll_up(
    runs: DataFrame, metric: str = MAIN_METRIC, best_is_max: bool = True, columns: Sequence[str] = ()
) -> DataFrame:
    """Per parent the run id and metrics of its best child; the latest wins a tie."""
    picked = best_row(
        runs.where(F.col("parent_run_id").isNotNull()),
        metric,
        best_is_max,
        tie=[F.desc("start_ms"), F.desc("run_id")],
        by=["parent_run_id"],
    )
    kept = [c for c in dict.fromkeys([metric, *columns])]
    return picked.select("parent_run_id", F.col("run_id").alias("best_run_id"), *kept)


def best_so_far(
    runs: DataFrame, metric: str = MAIN_METRIC, best_is_max: bool = True, blocks: int | None = None
) -> DataFrame:
    """Each child with the best child of its parent up to then; the latest wins a tie."""
    rows = _scored(runs.where(F.col("parent_run_id").isNotNull()), metric)
    signed = F.col(metric) if best_is_max else -F.col(metric)
    state = F.struct(signed.alias("m"), F.col("start_ms").alias("t"), F.col("run_id").alias("r"))
    out = running(rows, ["parent_run_id"], ["start_ms", "run_id"], maxima={"state": state}, blocks=blocks)
    best = F.col("state.m") if best_is_max else -F.col("state.m")
    return out.withColumns({"best_run_id": F.col("state.r"), f"best_{metric}": best}).drop("state")


def summarise_trials(
    scores: DataFrame,
    search: Sequence[str],
    trial: str,
    score: str,
    blocks: int | None = None,
    best_is_max: bool = True,
) -> DataFrame:
    """Mean, population deviation and competition rank per trial of a (trial, split, score) table."""
    search = list(search)
    summary = scores.groupBy(*search, trial).agg(
        F.avg(score).alias("mean_test_score"), F.stddev_pop(score).alias("std_test_score")
    )
    return competition_rank(summary, search, "mean_test_score", "rank_test_score", best_is_max, blocks)


def top_trials(trials: DataFrame, search: Sequence[str], trial: str, n: int = 5) -> DataFrame:
    """The ``n`` best trials per search, the first on ties."""
    return top_rows(trials, "mean_test_score", n, [trial], search)


def expand_params(trials: DataFrame, params: str = "params", names: Sequence[str] = ()) -> DataFrame:
    """One column ``param_<name>`` per entry of a parameter map, which is dropped."""
    return trials.withColumns({f"param_{n}": F.col(params)[n] for n in names}).drop(params)


def append_log(old: DataFrame, new: DataFrame, key: str = "run_id", tie: Sequence[Column | str] = ()) -> DataFrame:
    """Union in which the first row of each key stays; old rows come before new ones."""
    both = old.withColumn("source_", F.lit(0)).unionByName(
        new.withColumn("source_", F.lit(1)), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("source_", *tie)
    return both.withColumn("n_", F.row_number().over(order)).where(F.col("n_") == 1).drop("n_", "source_")


def find_or_new(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(parent_run_id, run_name, run_id, is_new) per wanted run.

    An existing child of that name is reused, the latest if there are several. A
    new id is a hash of parent and name, so a repeated task gives the same id.
    """
    named = top_rows(
        runs.select("parent_run_id", "run_name", "run_id", F.col("start_ms").cast("double").alias("started")),
        "started",
        1,
        [F.desc("run_id")],
        ["parent_run_id", "run_name"],
    ).drop("started")
    found = wanted.join(named, ["parent_run_id", "run_name"], "left")
    fresh = F.md5(F.concat_ws(":", F.col("parent_run_id").cast("string"), "run_name"))
    return found.select(
        "parent_run_id",
        "run_name",
        F.coalesce(F.col("run_id").cast("string"), fresh).alias("run_id"),
        F.col("run_id").isNull().alias("is_new"),
    )
