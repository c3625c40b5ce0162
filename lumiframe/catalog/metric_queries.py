"""Classification metrics, ROC points and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as met
from ..operators import roc
from .registry import query, rounded
from .views import SCORED_SQL, scored

_PAIRS = f"""WITH {SCORED_SQL},
labels AS (SELECT DISTINCT grp, truth AS l FROM scored UNION SELECT DISTINCT grp, pred FROM scored),
grid AS (SELECT a.grp, a.l AS truth, b.l AS pred FROM labels a JOIN labels b ON a.grp = b.grp),
counts AS (SELECT grp, truth, pred, count(*) AS n FROM scored GROUP BY ALL),
cm AS (SELECT grp, truth, pred, coalesce(n, 0)::BIGINT AS n FROM grid LEFT JOIN counts USING (grp, truth, pred))"""


def _report_sql(by: str) -> str:
    return f"""sup AS (SELECT {by}, truth AS label, count(*) AS support, count(*) FILTER (truth = pred) AS hits FROM scored GROUP BY ALL),
prd AS (SELECT {by}, pred AS label, count(*) AS predicted FROM scored GROUP BY ALL),
report AS (SELECT {by}, label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted,
  CASE WHEN predicted > 0 THEN coalesce(hits, 0) / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
  coalesce(2 * hits / (support + coalesce(predicted, 0)), 0) AS f1
  FROM sup FULL JOIN prd USING ({by}, label)),
metrics AS (SELECT {by}, sum(hits) / sum(support) AS acc, list_sum(list(recall ORDER BY label) FILTER (support > 0)) / count(*) FILTER (support > 0) AS balanced_accuracy,
  sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
  sum(f1 * support) / sum(support) AS f1, sum(support)::BIGINT AS n FROM report GROUP BY {by})"""


@query(f"{_PAIRS} SELECT grp, truth, pred, n FROM cm")
def confusion_counts(spark, sf):
    """A1."""
    return met.confusion(scored(spark, sf), "truth", "pred", ["grp"])


@query(
    f"""{_PAIRS}, lines AS (SELECT grp, truth, list(n ORDER BY pred) AS line FROM cm GROUP BY ALL)
SELECT grp, replace(list(line ORDER BY truth)::VARCHAR, ' ', '') AS cm FROM lines GROUP BY 1"""
)
def confusion_matrix(spark, sf):
    """A1 as nested lists."""
    rows = met.confusion_matrix(scored(spark, sf), "truth", "pred", ["grp"])
    return rows.select("grp", F.to_json("cm").alias("cm"))


@query(
    f"""WITH {SCORED_SQL}, {_report_sql('grp')}
SELECT grp, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report"""
)
def class_report(spark, sf):
    """A7."""
    report = met.class_report(scored(spark, sf), "truth", "pred", ["grp"])
    return report.select("grp", "label", "support", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


_SCORES = ("acc", "balanced_accuracy", "precision", "recall", "f1")
_SCORES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _SCORES)


@query(f"WITH {SCORED_SQL}, {_report_sql('grp')} SELECT grp, {_SCORES_SQL}, n FROM metrics")
def metrics_by_group(spark, sf):
    """A2 A3 A4 A5 A6."""
    rows = met.metrics(scored(spark, sf), "truth", "pred", ["grp"])
    return rows.select("grp", *[rounded(c).alias(c) for c in _SCORES], "n")


@query(
    f"""WITH {SCORED_SQL}, {_report_sql('l_partkey')}
SELECT l_partkey, {_SCORES_SQL}, n FROM metrics WHERE balanced_accuracy >= 70 / 100::DOUBLE"""
)
def gated_metrics(spark, sf):
    """Groups that reach the balanced-accuracy gate."""
    rows = met.metrics(scored(spark, sf), "truth", "pred", ["l_partkey"]).where(met.passes_gate())
    return rows.select("l_partkey", *[rounded(c).alias(c) for c in _SCORES], "n")


_EPS = "2.220446049250313e-16::DOUBLE"


@query(
    f"""WITH {SCORED_SQL}
SELECT grp, round(avg(-ln(least(greatest(proba[truth + 1], {_EPS}), 1 - {_EPS}))), 6) AS log_loss FROM scored GROUP BY 1"""
)
def log_loss(spark, sf):
    """A9."""
    return met.log_loss(scored(spark, sf), "truth", "proba", ["grp"]).withColumn("log_loss", rounded("log_loss"))


@query(
    f"""WITH {SCORED_SQL},
best AS (SELECT grp, (list_position(proba, list_max(proba)) - 1)::INT AS best, pred FROM scored)
SELECT grp, best, count(*) AS n, count(*) FILTER (best = pred) AS same FROM best GROUP BY ALL"""
)
def most_likely_class(spark, sf):
    """F11."""
    rows = scored(spark, sf).withColumn("best", met.argmax("proba"))
    return rows.groupBy("grp", "best").agg(
        F.count("*").alias("n"), F.count_if(F.col("best") == F.col("pred")).alias("same")
    )


_ROC = f"""WITH {SCORED_SQL},
flat AS (SELECT grp, truth, (i - 1)::INT AS class, proba[i] AS score FROM scored, range(1, 4) t(i)),
counts AS (SELECT grp, class, score, count(*) FILTER (truth = class) AS pos, count(*) FILTER (truth <> class) AS neg
           FROM flat GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY grp, class) AS n_pos, sum(neg) OVER (PARTITION BY grp, class) AS n_neg
        FROM counts WINDOW w AS (PARTITION BY grp, class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT grp, class, truth = class AS positive,
                  rank() OVER w + (count(*) OVER (PARTITION BY grp, class, score) - 1) / 2.0::DOUBLE AS r
           FROM flat WINDOW w AS (PARTITION BY grp, class ORDER BY score)),
auc AS (SELECT grp, class, (sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2)
               / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)) AS auc
        FROM ranked GROUP BY ALL)"""


@query(f"{_ROC} SELECT grp, class, score AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM cum")
def roc_points(spark, sf):
    """M15 W4."""
    points = roc.roc_points(scored(spark, sf), "truth", "proba", ["grp"])
    return points.select("grp", "class", "threshold", rounded("fpr").alias("fpr"), rounded("tpr").alias("tpr"))


@query(f"{_ROC} SELECT grp, class, round(auc, 6) AS auc FROM auc")
def auc_per_class(spark, sf):
    """The SQL side uses average ranks."""
    return roc.auc_per_class(scored(spark, sf), "truth", "proba", ["grp"]).withColumn("auc", rounded("auc"))


@query(f"{_ROC} SELECT grp, round(avg(auc), 6) AS auc FROM auc GROUP BY 1")
def auc_one_vs_rest(spark, sf):
    """A8."""
    return roc.auc_ovr(scored(spark, sf), "truth", "proba", ["grp"]).withColumn("auc", rounded("auc"))
