"""Plans: pruned scans, pushed filters, limits before the shuffle, no cross joins."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lumiframe.catalog import all_queries
from lumiframe.catalog.views import run_log, spectra, tabular
from lumiframe.operators import results as res
from lumiframe.operators.metrics import metrics
from lumiframe.operators.select import valid_rows
from lumiframe.operators.split import stratified_split
from lumiframe.plans import search as search_module
from lumiframe.plans.search import permuted_rows

QUERIES, _ = all_queries()


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


CHEAP = [
    "select_valid_samples",
    "validation_report",
    "encode_labels",
    "encode_many_labels",
    "split_tabular",
    "folds_shuffled",
    "scale_tabular",
    "metrics_by_group",
    "confusion_matrix",
    "roc_points",
    "back_projection",
    "nearest_neighbours_in_cells",
    "smote_rows",
    "pending_settings",
    "children_with_parent",
    "best_child_so_far",
    "trial_summary",
    "append_log",
    "find_or_create_run",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_join(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_needed(spark, data):
    text = plan(stratified_split(tabular(spark, data).select("key", "class"), "key", "class", 0.7))
    assert "l_tax" not in text and "l_shipdate" not in text
    assert "hashpartitioning" not in text and "rangepartitioning" not in text  # rows stay, only the few cuts move


def test_filters_reach_the_scan(spark, data):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").where(F.col("l_returnflag") == "A")
    rows = rows.select("l_orderkey", F.array("l_tax").alias("spectrum"), "l_linestatus")
    text = plan(valid_rows(rows, "l_linestatus"))
    assert "EqualTo(l_returnflag,A)" in text and "l_discount" not in text


def test_group_picks_are_limited_before_the_shuffle(spark, data):
    text = plan(res.roll_up(run_log(spark, data)))
    assert text.index("WindowGroupLimit") < text.index("Exchange")
    assert "TakeOrderedAndProject" in plan(res.best_row(run_log(spark, data), tie=["run_id"]))


def test_metrics_count_before_the_shuffle(spark, data):
    rows = spectra(spark, data).select("group_fam", F.col("sample_type").alias("p"))
    assert "partial_count" in plan(metrics(rows, "group_fam", "p"))


def test_projection_runs_once(spark, data):
    assert plan(QUERIES["pls_scores"](spark, data)).count("ArrowEvalPython [") <= 1
    assert "size(zip_with" not in plan(QUERIES["scale_spectra"](spark, data))


def test_rows_of_a_permutation_move_once(spark, monkeypatch):
    """Many parts, text keys, a key that repeats and a null one: the numbers of both orders, matched by SQL, in one shuffle of the rows."""
    monkeypatch.setattr(search_module, "PERMUTED_ROWS", 7)
    rows = [(f"k{i}", i % 2, [float(i)]) for i in range(200)] + [("k3", 1, [-3.0]), (None, 0, [9.0])]
    df = spark.createDataFrame(rows, "id string, code int, own array<double>").repartition(3)
    found = permuted_rows(df, "id", "own", 2, 52)
    df.createOrReplaceTempView("permuted_in")
    h = "conv(substring(md5(concat_ws(':', {})), 1, 8), 16, 10)"
    expected = spark.sql(
        f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY CAST({h.format("'52', 'own', id")} AS LONG), id) AS no FROM permuted_in),
d AS (SELECT id AS donor_id, r AS repeat, row_number() OVER (PARTITION BY r ORDER BY CAST({h.format("'52', CAST(r AS STRING), id")} AS LONG), id) AS no
      FROM permuted_in, (SELECT explode(array(0, 1)) AS r))
SELECT a.id, repeat, v.own AS donor, o.code, o.own FROM a JOIN d USING (no) JOIN permuted_in v ON v.id = donor_id JOIN permuted_in o ON o.id = a.id"""
    )
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1
