"""Settings, search spaces, run tables, trial summaries, logs and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import uniform
from ..operators import results as res
from ..operators import settings as st
from ..operators.ordering import competition_rank
from ..plans import shaping
from ..sources.runs import from_split_json, to_split_json
from .registry import query, rounded
from .views import PATHS_SQL, RUN_LOG_SQL, SETTINGS_SQL, configs, paths, run_log, table, u_sql

_SETTING = (
    "search_to_use, model_type, train_percentage, sample_type, target, scale, apply_pls, "
    "apply_smote_resampling, n_components"
)


def _settings(spark, sf):
    return st.expand_settings(configs(spark, sf), keep=["experiment"])


@query(f"WITH {SETTINGS_SQL} SELECT experiment, position, {_SETTING} FROM settings")
def expand_settings(spark, sf):
    """Nine lists of each experiment, in nesting order."""
    return _settings(spark, sf)


@query(f"WITH {SETTINGS_SQL} SELECT model_type, search_to_use, count(*) AS n FROM named GROUP BY ALL")
def display_names(spark, sf):
    """J3 F13."""
    named = st.display_names(_settings(spark, sf))
    return named.groupBy("model_type", "search_to_use").agg(F.count("*").alias("n"))


_U = u_sql("'52:'||experiment||':'||position")


def _log(named):
    """Finished settings, some of them logged twice."""
    finished = named.where(uniform(52, F.col("experiment"), F.col("position")) < 0.4)
    return finished.unionByName(finished.where(F.col("position") % 2 == 0))


_KEYS = ("experiment", *st.SETTING_COLUMNS)


@query(f"WITH {SETTINGS_SQL} SELECT experiment, position, {_SETTING} FROM named WHERE {_U} >= 0.4")
def pending_settings(spark, sf):
    """Settings without an equal row in the log, with missing component counts."""
    named = st.display_names(_settings(spark, sf))
    return st.pending(named, _log(named), _KEYS)


@query(f"WITH {SETTINGS_SQL} SELECT experiment, position FROM named WHERE {_U} < 0.4")
def done_settings(spark, sf):
    """J1."""
    named = st.display_names(_settings(spark, sf))
    return st.done(named, _log(named), _KEYS).select("experiment", "position")


@query(
    """SELECT s_suppkey, ((((a.i - 1) * 3 + (b.i - 1)) * 2 + (c.i - 1)) * 2 + (d.i - 1)) AS trial,
  ([100, 200])[a.i]::INT AS n_estimators, ([4, 8, 12])[b.i]::INT AS max_depth,
  (['sqrt', 'log2'])[c.i] AS max_features, (['gini', 'entropy'])[d.i] AS criterion
FROM supplier, range(1, 3) a(i), range(1, 4) b(i), range(1, 3) c(i), range(1, 3) d(i)"""
)
def search_grid(spark, sf):
    """M9: the random-forest grid (24 trials) per supplier, each standing for one search."""
    space = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.array(F.lit(100), F.lit(200)).alias("n_estimators"),
        F.array(F.lit(4), F.lit(8), F.lit(12)).alias("max_depth"),
        F.array(F.lit("sqrt"), F.lit("log2")).alias("max_features"),
        F.array(F.lit("gini"), F.lit("entropy")).alias("criterion"),
    )
    return st.grid(space, ["n_estimators", "max_depth", "max_features", "criterion"])


_DIMS = (
    ("n_estimators", "integer", 50.0, 300.0),
    ("subsample", "real", 0.5, 1.0),
    ("alpha", "log", 1e-6, 1e-1),
    ("activation", "choice", None, None),
)
_DIMS_SQL = ", ".join(
    f"('{n}', '{k}', {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)"
    for n, k, lo, hi in _DIMS
)
_DU = u_sql("'52:'||model||':'||name||':'||trial")


@query(
    f"""WITH space AS (SELECT s_suppkey::VARCHAR AS model, name, kind, low, high
  FROM supplier, (VALUES {_DIMS_SQL}) d(name, kind, low, high)),
drawn AS (SELECT *, i::INT AS trial FROM space, range(50) t(i)),
us AS (SELECT *, {_DU} AS u FROM drawn)
SELECT model, trial, name,
  round(CASE kind WHEN 'integer' THEN floor(low + u * (high - low + 1)) WHEN 'real' THEN low + u * (high - low)
       WHEN 'log' THEN low * pow(high / low, u) END, 6) AS number,
  CASE WHEN kind = 'choice' THEN (['relu','tanh','logistic'])[floor(u * 3)::INT + 1] END AS choice
FROM us"""
)
def search_samples(spark, sf):
    """M9: 50 draws of an integer, a real, a log-uniform and a categorical dimension."""
    dims = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.lit(k).alias("kind"),
                F.lit(lo).cast("double").alias("low"),
                F.lit(hi).cast("double").alias("high"),
            )
            for n, k, lo, hi in _DIMS
        ]
    )
    space = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("model"), F.inline(dims))
    space = space.withColumn(
        "choices", F.when(F.col("kind") == "choice", F.array(F.lit("relu"), F.lit("tanh"), F.lit("logistic")))
    )
    return st.sample_space(space, 50).withColumn("number", rounded("number"))


@query(f"WITH {RUN_LOG_SQL} SELECT sample_type, max(acc) AS acc FROM run_log GROUP BY 1")
def leaderboard(spark, sf):
    """A11 M16."""
    return res.leaderboard(run_log(spark, sf), "acc", ["sample_type"])


@query(f"WITH {RUN_LOG_SQL} SELECT model_type, min(f1) AS f1 FROM run_log WHERE NOT isnan(f1) GROUP BY 1")
def leaderboard_of_losses(spark, sf):
    """A11 with the smallest value; missing values never count."""
    return res.leaderboard(run_log(spark, sf), "f1", ["model_type"], best_is_max=False)


@query(
    f"""WITH {RUN_LOG_SQL} SELECT run_id, sample_type, f1 FROM run_log WHERE NOT isnan(f1)
QUALIFY row_number() OVER (PARTITION BY sample_type ORDER BY f1 DESC, run_id) = 1"""
)
def best_run_per_type(spark, sf):
    """The first row wins a tie, missing values are skipped."""
    return res.best_row(run_log(spark, sf), "f1", tie=["run_id"], by=["sample_type"]).select("run_id", "sample_type", "f1")


@query(f"WITH {RUN_LOG_SQL} SELECT run_id, model_type, f1 FROM run_log WHERE NOT isnan(f1) ORDER BY f1, run_id LIMIT 1")
def best_run_overall(spark, sf):
    """Smallest value."""
    return res.best_row(run_log(spark, sf), "f1", best_is_max=False, tie=["run_id"]).select("run_id", "model_type", "f1")


@query(
    f"""WITH {RUN_LOG_SQL} SELECT c.run_id, c.parent_run_id, c.acc, p.acc AS parent_acc, p.sample_type AS parent_sample_type
FROM run_log c JOIN run_log p ON c.parent_run_id = p.run_id"""
)
def children_with_parent(spark, sf):
    """J5."""
    rows = res.with_parent(run_log(spark, sf), ["acc", "sample_type"])
    return rows.select("run_id", "parent_run_id", "acc", "parent_acc", "parent_sample_type")


@query(
    f"""WITH {RUN_LOG_SQL} SELECT parent_run_id, run_id AS best_run_id, acc, f1 FROM run_log
QUALIFY row_number() OVER (PARTITION BY parent_run_id ORDER BY acc DESC, start_ms DESC, run_id DESC) = 1"""
)
def roll_up_best_child(spark, sf):
    """The best child of each parent, the latest on a tie."""
    return res.roll_up(run_log(spark, sf), "acc", columns=["f1"])


@query(
    f"""WITH {RUN_LOG_SQL},
best AS (SELECT run_id, parent_run_id, acc, max({{'m': acc, 't': start_ms, 'r': run_id}}) OVER
           (PARTITION BY parent_run_id ORDER BY start_ms, run_id ROWS UNBOUNDED PRECEDING) AS b FROM run_log)
SELECT run_id, parent_run_id, acc, b.r AS best_run_id, b.m AS best_acc FROM best"""
)
def best_child_so_far(spark, sf):
    """W5."""
    return res.best_so_far(run_log(spark, sf), "acc").select(
        "run_id", "parent_run_id", "acc", "best_run_id", "best_acc"
    )


@query(
    f"""WITH {RUN_LOG_SQL},
best AS (SELECT run_id, sample_type AS parent_run_id, max({{'m': -acc, 't': start_ms, 'r': run_id}}) OVER
           (PARTITION BY sample_type ORDER BY start_ms, run_id ROWS UNBOUNDED PRECEDING) AS b FROM run_log)
SELECT run_id, parent_run_id, b.r AS best_run_id, 0.0::DOUBLE - b.m AS best_acc FROM best"""
)
def best_child_so_far_hot(spark, sf):
    """W5 with three parents that hold all runs, and the smallest value."""
    runs = run_log(spark, sf).withColumn("parent_run_id", F.col("sample_type"))
    rows = res.best_so_far(runs, "acc", best_is_max=False).withColumn("best_acc", F.col("best_acc") + F.lit(0.0))
    return rows.select("run_id", "parent_run_id", "best_run_id", "best_acc")


def _split_scores(spark, sf):
    """Five split scores per run, in eighths so that sums are exact."""
    runs = run_log(spark, sf).select(F.col("parent_run_id").alias("search"), F.col("run_id").alias("trial"))
    splits = runs.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return splits.withColumn("score", ((F.col("trial") * 7919 + F.col("split") * 31) % 9) / F.lit(8.0))


_TRIALS_SQL = f"""{RUN_LOG_SQL},
scores AS (SELECT parent_run_id AS search, run_id AS trial, i AS split, ((run_id*7919 + i*31) % 9)::DOUBLE/8.0::DOUBLE AS score
           FROM run_log, range(5) t(i)),
means AS (SELECT search, trial, avg(score) AS m, stddev_pop(score) AS s FROM scores GROUP BY ALL),
trials AS (SELECT search, trial, m, s, rank() OVER (PARTITION BY search ORDER BY m DESC)::INT AS r FROM means)"""


@query(
    f"""WITH {_TRIALS_SQL}
SELECT search, trial, round(m, 6) AS mean_test_score, round(s, 6) AS std_test_score, r AS rank_test_score FROM trials"""
)
def trial_summary(spark, sf):
    """Mean, deviation and competition rank per trial."""
    rows = res.summarise_trials(_split_scores(spark, sf), ["search"], "trial", "score")
    return rows.select(
        "search",
        "trial",
        rounded("mean_test_score").alias("mean_test_score"),
        rounded("std_test_score").alias("std_test_score"),
        "rank_test_score",
    )


@query(
    f"""WITH {_TRIALS_SQL} SELECT search, trial, r AS rank_test_score FROM trials
QUALIFY row_number() OVER (PARTITION BY search ORDER BY m DESC, trial) <= 5"""
)
def top_trials(spark, sf):
    """T3 T4."""
    rows = res.summarise_trials(_split_scores(spark, sf), ["search"], "trial", "score")
    return res.top_trials(rows, ["search"], "trial").select("search", "trial", "rank_test_score")


@query(
    f"""WITH {_TRIALS_SQL},
lists AS (SELECT search AS run_id, list(r ORDER BY trial) AS ranks, list(m ORDER BY trial) AS means,
                 list(trial % 3 ORDER BY trial) AS depths FROM trials GROUP BY 1)
SELECT run_id, len(ranks)::INT AS n_trials, (list_position(ranks, 1) - 1)::INT AS best_index,
  round(means[list_position(ranks, 1)], 6) AS best_score,
  '{{"max_depth":"'||depths[list_position(ranks, 1)]||'"}}' AS best_params, list_sum(ranks)::BIGINT AS rank_sum,
  'Random Forest (GridSearchCV)' AS model, run_id % 7 / 10.0::DOUBLE AS accuracy_score FROM lists"""
)
def cross_validation_summary(spark, sf):
    """The trials of each run as arrays, its best trial and parameters."""
    scores = _split_scores(spark, sf).withColumnRenamed("search", "run_id")
    trials = res.summarise_trials(scores, ["run_id"], "trial", "score").withColumn(
        "params", F.create_map(F.lit("max_depth"), (F.col("trial") % 3).cast("string"))
    )
    log = scores.select("run_id").distinct().select(
        "run_id",
        F.lit("group_fam").alias("target"),
        F.lit("SERUM").alias("sample_type"),
        F.lit(0.8).alias("train_percentage"),
        F.lit("Random Forest").alias("model_type"),
        F.lit("GridSearchCV").alias("search_to_use"),
        *[(F.col("run_id") % 7 / F.lit(10.0)).alias(c) for c in ("test_acc", "f1", "recall", "precision", "acc")],
        F.array(F.array(F.lit(1))).alias("cm"),
    )
    rows = shaping.cv_summary(shaping.trial_table(trials, scores, log), log)
    return rows.select(
        "run_id",
        F.size("mean_test_score").alias("n_trials"),
        "best_index",
        rounded(F.get("mean_test_score", F.col("best_index"))).alias("best_score"),
        F.col("Best Params").alias("best_params"),
        F.aggregate("rank_test_score", F.lit(0).cast("long"), lambda a, r: a + r).alias("rank_sum"),
        F.col("Model").alias("model"),
        "accuracy_score",
    )


@query(
    f"""WITH {RUN_LOG_SQL} SELECT sample_type, run_id, acc,
  rank() OVER (PARTITION BY sample_type ORDER BY acc DESC)::INT AS rank FROM run_log"""
)
def rank_with_ties(spark, sf):
    """W3 over groups that hold a third of the rows each."""
    return competition_rank(run_log(spark, sf).select("sample_type", "run_id", "acc"), ["sample_type"], "acc", "rank")


@query(
    f"""WITH {RUN_LOG_SQL} SELECT run_id AS trial, acc, run_name AS param_criterion,
  (run_id % 3)::VARCHAR AS param_max_depth, NULL::VARCHAR AS param_gamma FROM run_log"""
)
def expand_trial_params(spark, sf):
    """One column per parameter of a map, absent ones missing."""
    rows = run_log(spark, sf).select(
        F.col("run_id").alias("trial"),
        "acc",
        F.create_map(
            F.lit("criterion"), F.col("run_name"), F.lit("max_depth"), (F.col("run_id") % 3).cast("string")
        ).alias("params"),
    )
    return res.expand_params(rows, names=["criterion", "max_depth", "gamma"])


def _old_and_new(spark, sf):
    runs = run_log(spark, sf).select("run_id", "parent_run_id", "acc", "start_ms")
    old = runs.where(F.col("acc") < 0.6)
    new = runs.where(F.col("acc") >= 0.4).withColumns(
        {"acc": F.col("acc") + 1.0, "run_name": F.col("parent_run_id").cast("string")}
    )
    return old, new


@query(
    f"""WITH {RUN_LOG_SQL}
SELECT run_id, acc, NULL::VARCHAR AS run_name FROM run_log WHERE acc < 0.6
UNION ALL SELECT run_id, acc + 1.0::DOUBLE, parent_run_id::VARCHAR FROM run_log WHERE acc >= 0.6"""
)
def append_log(spark, sf):
    """The old row of a run stays."""
    old, new = _old_and_new(spark, sf)
    return res.append_log(old, new).select("run_id", "acc", "run_name")


@query(
    f"""WITH {RUN_LOG_SQL}
SELECT 'old' AS part, count(*) AS n, count(NULL) AS named FROM run_log WHERE acc < 0.6
UNION ALL SELECT 'new', count(*), count(*) FROM run_log WHERE acc >= 0.4"""
)
def union_results(spark, sf):
    """Result tables with different columns."""
    old, new = _old_and_new(spark, sf)
    both = old.withColumn("part", F.lit("old")).unionByName(
        new.withColumn("part", F.lit("new")), allowMissingColumns=True
    )
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count("run_name").alias("named"))


@query(
    f"""WITH {RUN_LOG_SQL},
wanted AS (SELECT c_custkey AS parent_run_id, name AS run_name FROM customer, (SELECT DISTINCT run_name AS name FROM run_log
           UNION ALL SELECT 'GridSearchCV')),
named AS (SELECT parent_run_id, run_name, run_id FROM run_log
          QUALIFY row_number() OVER (PARTITION BY parent_run_id, run_name ORDER BY start_ms DESC, run_id DESC) = 1)
SELECT parent_run_id, run_name, coalesce(run_id::VARCHAR, md5(parent_run_id||':'||run_name)) AS run_id, run_id IS NULL AS is_new
FROM wanted LEFT JOIN named USING (parent_run_id, run_name)"""
)
def find_or_create_run(spark, sf):
    """Reuse the latest child of that name, else a new id."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "GridSearchCV"]
    wanted = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("parent_run_id"), F.explode(F.array(*[F.lit(n) for n in names])).alias("run_name")
    )
    return res.find_or_new(run_log(spark, sf), wanted)


@query(
    f"""WITH {PATHS_SQL}
SELECT o_orderkey, ([{", ".join("'" + n + "'" for n in ("CAPILAR", "PLASMA", "SALIVA", "SERUM", "URINE"))}])[(o_orderkey % 5 + 1)::INT] AS sample_type,
  ([0.8::DOUBLE, 0.7::DOUBLE, 0.575::DOUBLE])[(o_orderkey % 3 + 1)::INT] AS train_percentage,
  split_part(split_part(path, '_', 5), '_', 1) AS test_name, 'target '||(o_orderkey % 7) AS target_variable,
  (o_orderkey*7919 % 1000)::DOUBLE/1000.0::DOUBLE AS accuracy,
  (['Random Forest','MLP','XGBoost'])[(o_orderkey % 3 + 1)::INT] AS model,
  CASE WHEN o_orderkey % 2 = 0 THEN 'GridSearchCV' ELSE 'BayesSearchCV' END AS search_type
FROM paths WHERE o_orderkey % 50 <> 0"""
)
def parse_importance_paths(spark, sf):
    """Facts from paths that match."""
    facts = paths(spark, sf).withColumn("f", text.parse_importance_path("path"))
    return facts.where(F.col("f").isNotNull()).select("o_orderkey", "f.*")


@query(f"WITH {PATHS_SQL} SELECT o_orderkey, path FROM paths WHERE o_orderkey % 50 = 0")
def quarantined_paths(spark, sf):
    """paths that do not match."""
    facts = paths(spark, sf).withColumn("f", text.parse_importance_path("path"))
    return facts.where(F.col("f").isNull()).select("o_orderkey", "path")


@query(
    f"""WITH {SETTINGS_SQL}
SELECT experiment, position, 'group_fam_ROC_'||sample_type||'_'||
    CASE train_percentage WHEN 0.8 THEN '80' WHEN 0.7 THEN '70' ELSE '60' END||'pct_'||model_type||' ('||search_to_use||')' AS file,
  CASE WHEN experiment % 3 = 0 THEN '_B' ELSE '_group_fam' END AS suffix
FROM named"""
)
def result_names(spark, sf):
    """Names of runs and files."""
    named = st.display_names(_settings(spark, sf))
    group = F.when(F.col("experiment") % 3 == 0, "B")
    return named.select(
        "experiment",
        "position",
        text.plot_file(
            F.col("target"), "ROC", F.col("sample_type"), F.col("train_percentage"), text.test_name("model_type", "search_to_use")
        ).alias("file"),
        text.group_suffix(group, F.col("target")).alias("suffix"),
    )


@query(
    f"""WITH {RUN_LOG_SQL} SELECT run_id, sample_type, run_name, acc FROM run_log"""
)
def split_layout_round_trip(spark, sf):
    """one-row tables written as JSON split layout and read back."""
    runs = run_log(spark, sf).select("run_id", "sample_type", "run_name", "acc")
    packed = runs.select(to_split_json(["run_id", "sample_type", "run_name", "acc"]).alias("value"))
    return from_split_json(packed, "value", "run_id bigint, sample_type string, run_name string, acc double")


