"""Readers, writers and names."""

import json

import pytest
from pyspark.sql import functions as F

from lumiframe.constants import METADATA_COLUMNS, SETTING_COLUMNS
from lumiframe.functions import text
from lumiframe.operators import results as res
from lumiframe.operators.select import require_same_columns, select_samples
from lumiframe.operators.settings import display_names, expand_settings, pending
from lumiframe.plans.experiment import LOG_SCHEMA
from lumiframe.sources import sinks
from lumiframe.sources.importance import read_importance_files
from lumiframe.sources.runs import _one_value, append_rows, read_run_store, read_split_json
from lumiframe.sources.settings import read_settings
from lumiframe.sources.wide import pack, read_for_scoring, read_wide, unpack

WAVES = ["399.5", "1850", "2500.25"]


def wide_file(path, lines):
    columns = [*METADATA_COLUMNS, *WAVES]
    rows = []
    for values in lines:
        rows.append(",".join(str(values.get(c, "")) for c in columns))
    path.write_text(",".join(columns) + "\n" + "\n".join(rows) + "\n")
    return str(path)


def sample(i, **other):
    return {"id": f"s{i}", "sample_type": "SERUM", "group_fam": "A", "ffm_%": 0.5, **dict.fromkeys(WAVES, i + 0.5), **other}


def test_wide_csv(spark, tmp_path):
    path = wide_file(
        tmp_path / "w.csv",
        [
            sample(1),
            sample(2, group_fam="NA"),
            sample(3, **{"1850": "NaN"}),
            sample(4, **{"399.5": "null"}),
            sample(5, **dict.fromkeys(WAVES, 0)),
            sample(6, sample_type="URINE", age_years="n/a"),
            sample(7, **{"399.5": 0}),
        ],
    )
    df, axis = read_wide(spark, path)
    assert [tuple(r) for r in axis.orderBy("pos").collect()] == [(0, 399.5), (1, 1850.0), (2, 2500.25)]
    assert df.columns == [*METADATA_COLUMNS, "spectrum"]
    rows = {r["id"]: r for r in df.collect()}
    assert rows["s1"]["ffm_%"] == 0.5 and rows["s2"]["group_fam"] is None and rows["s6"]["age_years"] is None
    assert [r["id"] for r in select_samples(df, "group_fam", "SERUM").orderBy("id").collect()] == ["s1", "s7"]
    assert select_samples(df, "no_such", "SERUM").head()["no_such"] == 1.0
    with pytest.raises(ValueError, match="URINE"):
        select_samples(df, "group_fam", "PLASMA")
    with pytest.raises(ValueError, match="no value"):
        select_samples(df, "timepoint", "SERUM")
    stored = str(tmp_path / "p")
    unpack(df.select("id", "sample_type", "spectrum"), WAVES).write.parquet(stored)
    again, _ = read_wide(spark, stored, ["id", "sample_type"], fmt="parquet")
    assert again.where("id = 's1'").head()["spectrum"] == [1.5, 1.5, 1.5]


def test_axis_names_must_be_numbers(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, `12.5 cm` double")
    with pytest.raises(ValueError, match="12.5 cm"):
        pack(df, ["id"])


def test_column_contract(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert require_same_columns(df, ["b", "a"]) is df
    with pytest.raises(ValueError, match=r"missing \['c'\], unexpected \['b'\]"):
        require_same_columns(df, ["a", "c"])


def test_settings_file(spark, tmp_path):
    path = tmp_path / "e.json"
    lists = {
        "experiment_name": "Phase 1",
        "searchs_hipermetrics": ["grid", "bayes"],
        "model_types_to_train": ["random_forest", "mlp_classifier", "decision_tree", "xgboost"],
        "train_percentages": [0.8, 0.7, 0.6],
        "sample_types": ["CAPILAR", "PLASMA", "SALIVA", "SERUM", "URINE"],
        "targets_to_predict": ["group_fam"],
    }
    path.write_text(json.dumps(lists, indent=2))
    config = read_settings(spark, str(path))
    rows = expand_settings(config).orderBy("position").collect()
    assert len(rows) == 120 and [r["position"] for r in rows] == list(range(120))
    first = rows[0].asDict()
    assert (first["search_to_use"], first["model_type"], first["sample_type"]) == ("grid", "random_forest", "CAPILAR")
    assert first["scale"] is True and first["n_components"] == 10
    assert rows[1]["sample_type"] == "PLASMA" and rows[5]["train_percentage"] == 0.7
    assert config.head()["run_name"] == "demo" and config.head()["selected_group_fam"] is None

    path.write_text(json.dumps({**lists, "apply_pls": [False], "n_components": [5, 10]}))
    rows = expand_settings(read_settings(spark, str(path)))
    assert rows.count() == 120 and rows.where("n_components is null").count() == 120

    named = display_names(rows)
    finished = named.where("model_type = 'MLP'").select(*SETTING_COLUMNS)
    assert pending(named, finished.union(finished)).where("model_type = 'MLP'").count() == 0
    assert pending(named, finished).count() == 90
    assert pending(named, named).count() == 0


def test_run_store(spark, tmp_path):
    def run(name, parent=None, metrics=(), params=()):
        for folder in ("metrics", "params", "tags"):
            (tmp_path / "1" / name / folder).mkdir(parents=True)
        (tmp_path / "1" / name / "meta.yaml").write_text(
            f"artifact_uri: x\nend_time: 20\nexperiment_id: '1'\nrun_id: {name}\nrun_name: Random Forest\nstart_time: 10\n"
        )
        for key, lines in metrics:
            (tmp_path / "1" / name / "metrics" / key).write_text(lines)
        for key, value in params:
            (tmp_path / "1" / name / "params" / key).write_text(value)
        if parent:
            (tmp_path / "1" / name / "tags" / "mlflow.parentRunId").write_text(parent)

    run("aa", metrics=[("acc", "1 0.5 0\n2 0.75 0\n")])
    run("bb", "aa", metrics=[("best score", "3 0.25 1\n")], params=[("max_depth", "8")])
    tables = read_run_store(spark, str(tmp_path / "1"))
    runs = {r["run_id"]: r for r in tables["runs"].collect()}
    assert runs["bb"]["parent_run_id"] == "aa" and runs["aa"]["parent_run_id"] is None
    assert (runs["aa"]["run_name"], runs["aa"]["start_ms"], runs["aa"]["end_ms"]) == ("Random Forest", 10, 20)
    lines = {tuple(r) for r in tables["metrics"].collect()}
    assert lines == {("aa", "acc", 1, 0.5, 0), ("aa", "acc", 2, 0.75, 0), ("bb", "best score", 3, 0.25, 1)}
    assert [tuple(r) for r in tables["params"].collect()] == [("bb", "max_depth", "8")]
    assert res.children(tables["runs"], "aa").head()["run_id"] == "bb"


def test_split_layout_file(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "run_results.json").write_text(
        '{"columns": ["target", "scale", "n_components", "run_id", "test_acc", "cm", "roc_auc"], '
        '"data": [["group_fam", true, 10, "6a", 0.7612958227, [[10, 2, 5], [0, 39, 0], [3, 4, 16]], 0.935735795]]}'
    )
    row = read_split_json(spark, str(tmp_path / "*" / "run_results.json"), LOG_SCHEMA).head()
    assert row["target"] == "group_fam" and row["scale"] is True and row["n_components"] == 10
    assert row["cm"] == [[10, 2, 5], [0, 39, 0], [3, 4, 16]] and row["test_acc"] == 0.7612958227
    assert row["f1"] is None


def test_importance_tree(spark, tmp_path):
    good = "wavenumbers_importance_SERUM_80pct_Random Forest (GridSearchCV)_acc_0.91.csv"
    for target in ("group_fam", "vo2 max"):
        (tmp_path / target).mkdir()
        (tmp_path / target / good).write_text("Wavenumber,Importance\n400.5,0.25\n500,0.5\n")
    (tmp_path / "group_fam" / "notes.csv").write_text("Wavenumber,Importance\n1,1\n")
    (tmp_path / "group_fam" / "deeper").mkdir()
    (tmp_path / "group_fam" / "deeper" / good).write_text("Wavenumber,Importance\n9,9\n")
    known, unknown = read_importance_files(spark, str(tmp_path))
    rows = [r.asDict() for r in known.orderBy("target_variable", "Wavenumber").collect()]
    assert len(rows) == 4 and {r["target_variable"] for r in rows} == {"group_fam", "vo2 max"}
    assert rows[0] == {
        "Wavenumber": 400.5,
        "Importance": 0.25,
        "sample_type": "SERUM",
        "train_percentage": 0.8,
        "test_name": "Random Forest (GridSearchCV)",
        "target_variable": "group_fam",
        "accuracy": 0.91,
        "model": "Random Forest",
        "search_type": "GridSearchCV",
    }
    assert [r["path"].rsplit("/", 1)[1] for r in unknown.collect()] == ["notes.csv"]
    other = good.replace("SERUM", "URINE")
    (tmp_path / "group_fam" / other).write_text('Importance,Note,Wavenumber\n0.75,"a, b",600\n')
    united, _ = read_importance_files(spark, str(tmp_path))
    mixed = {(r["Wavenumber"], r["Importance"], r["Note"]) for r in united.where("target_variable = 'group_fam'").collect()}
    assert mixed == {(400.5, 0.25, None), (500.0, 0.5, None), (600.0, 0.75, "a, b")}
    sinks.save_table(united, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_names(spark):
    df = spark.createDataFrame([("random_forest", 0.57, None, "grp"), ("xgboost", 0.8, "B", "grp")], "m string, f double, g string, t string")
    row = df.select(
        text.display_name("m").alias("n"),
        text.percent("f").alias("p"),
        text.group_suffix("g", F.col("t")).alias("s"),
        text.group_suffix("g").alias("e"),
        text.test_name("m", F.lit("GridSearchCV")).alias("x"),
    ).collect()
    assert tuple(row[0]) == ("Random Forest", 56, "_grp", "", "random_forest (GridSearchCV)")
    assert tuple(row[1]) == ("Xgboost", 80, "_B", "_B", "xgboost (GridSearchCV)")


def test_log_keeps_the_first_row(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "run_id string, acc double")
    sinks.save_log(first, path)
    log = sinks.save_log(spark.createDataFrame([("b", 9.0), ("c", 3.0), ("c", 3.0)], "run_id string, acc double"), path)
    assert sorted(map(tuple, log.collect())) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    append_rows(first, str(tmp_path / "rows"))
    append_rows(first, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4


def test_named_files_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([("a b/x+1.txt", "one"), ("c.txt", None)], "path string, text string")
    assert sinks.save_named(df, str(tmp_path)) == 2
    assert sinks.save_named(df.withColumn("text", F.upper("text")), f"file://{tmp_path}") == 2
    assert (tmp_path / "a b" / "x+1.txt").read_text() == "ONE" and (tmp_path / "c.txt").read_text() == ""
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["c.txt", "x+1.txt"]
    assert sinks.save_named(df.limit(0), str(tmp_path)) == 0
    with pytest.raises(Exception, match="needs a name"):
        sinks.save_named(df.withColumn("path", F.lit(None).cast("string")), str(tmp_path))


def most_tasks(spark, group, run):
    """Tasks of the largest stage that ``run`` starts."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        run()
        seen = context.statusTracker()
        stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds]
        return max(s.numTasks for s in stages if s)
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(name, None)


def test_many_files_of_one_partition_are_dealt_out_and_listed_in_batches(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    runs = F.concat(F.lit("r"), "id", F.lit("/params/nation")).alias("path")
    df = spark.range(0, 5 * cores, 1, 1).select(runs, F.col("id").cast("string").alias("text"))
    assert most_tasks(spark, "written", lambda: sinks.save_named(df, str(tmp_path))) == 2 * cores
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    found = []
    assert most_tasks(spark, "listed", lambda: found.append(_one_value(spark, str(tmp_path), "params"))) == 4 * cores
    assert spark.conf.get(name, None) == before
    assert {(r["run_id"], r["value"]) for r in found[0].collect()} == {(f"r{i}", str(i)) for i in range(5 * cores)}


def test_results_by_target(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "target_variable string, Accuracy double")
    sinks.save_results({"results_summary": df}, str(tmp_path), "json")
    assert (tmp_path / "results_summary" / "target_variable=x").is_dir()
    assert spark.read.json(str(tmp_path / "results_summary")).count() == 2


def test_find_or_new_reuses_the_latest(spark):
    runs = spark.createDataFrame(
        [("p", "SERUM", "r1", 1), ("p", "SERUM", "r2", 5), ("q", "SERUM", "r3", 9)],
        "parent_run_id string, run_name string, run_id string, start_ms long",
    )
    wanted = spark.createDataFrame([("p", "SERUM"), ("p", "URINE")], "parent_run_id string, run_name string")
    found = {r["run_name"]: r for r in res.find_or_new(runs, wanted).collect()}
    assert found["SERUM"]["run_id"] == "r2" and not found["SERUM"]["is_new"]
    assert found["URINE"]["is_new"] and len(found["URINE"]["run_id"]) == 32


def test_latest_child_wins_a_tie(spark):
    runs = spark.createDataFrame(
        [("p", "a", 1, 0.6324, 0.57), ("p", "b", 2, 0.6324, 0.5813), ("p", "c", 3, float("nan"), 0.9), ("p", "d", 4, 0.5, 0.4)],
        "parent_run_id string, run_id string, start_ms long, acc double, test_acc double",
    )
    assert tuple(res.roll_up(runs, "acc", columns=["test_acc"]).head()) == ("p", "b", 0.6324, 0.5813)
    so_far = [r["best_run_id"] for r in res.best_so_far(runs, "acc").orderBy("start_ms").collect()]
    assert so_far == ["a", "b", "b"]
    assert res.best_row(runs, "acc", False, ["run_id"]).head()["run_id"] == "d"


def test_new_rows_follow_the_example(spark, tmp_path):
    example = wide_file(tmp_path / "e.csv", [sample(0)])
    columns = [*METADATA_COLUMNS, *WAVES][::-1]
    values = sample(1, **{"399.5": 1, "1850": 2, "2500.25": 3})
    path = tmp_path / "n.csv"
    path.write_text(",".join(columns) + "\n" + ",".join(str(values.get(c, "")) for c in columns) + "\n")
    df, axis = read_for_scoring(spark, str(path), example)
    assert df.head()["spectrum"] == [1.0, 2.0, 3.0] and df.head()["id"] == "s1"
    assert [r["wavenumber"] for r in axis.orderBy("pos").collect()] == [399.5, 1850.0, 2500.25]
    path.write_text(",".join(columns[1:]) + "\n")
    with pytest.raises(ValueError, match="columns differ"):
        read_for_scoring(spark, str(path), example)
