"""Files under fixed names and layouts: written from the given tables by tasks, read back, compared with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.importance import read_importance_files
from ..sources.runs import PARENT_TAG, read_run_store, read_split_json, to_split_json
from ..sources.settings import read_settings
from ..sources.sinks import save_named
from .registry import query
from .store_queries import _folder
from .views import table


@query(
    """SELECT n_name AS experiment_name, CASE WHEN n_nationkey % 2 = 0 THEN 'demo' ELSE 'run ' || n_nationkey END AS run_name,
  CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END::INT AS searches, n_nationkey % 3 = 0 AS scale,
  CASE WHEN n_nationkey % 5 = 0 THEN 10 ELSE n_nationkey END::INT AS components, 0::INT AS types
FROM nation"""
)
def settings_files(spark, sf):
    """One configuration file a nation; absent keys get their defaults."""
    root, key = f"{_folder(spark)}/settings", F.col("n_nationkey")
    odd = key % 2 == 1
    fields = F.struct(
        F.col("n_name").alias("experiment_name"),
        F.when(odd, F.concat(F.lit("run "), key)).alias("run_name"),
        F.when(odd, F.array(F.lit("grid"), F.lit("bayes"))).otherwise(F.array(F.lit("grid"))).alias("searchs_hipermetrics"),
        F.when(key % 3 != 0, F.array(F.lit(False))).alias("scale"),
        F.when(key % 5 != 0, F.array(key)).alias("n_components"),
    )
    text = F.to_json(fields, {"pretty": "true"})
    save_named(table(spark, sf, "nation").select(F.concat(key, F.lit(".json")).alias("path"), text.alias("text")), root)
    return read_settings(spark, f"{root}/*.json").select(
        "experiment_name",
        "run_name",
        F.size("searchs_hipermetrics").alias("searches"),
        F.col("scale")[0].alias("scale"),
        F.col("n_components")[0].alias("components"),
        F.size("sample_types").alias("types"),
    )


@query(
    """SELECT r_name AS target_variable, 'T' || n_nationkey AS sample_type, 0.8::DOUBLE AS train_percentage,
  'Random Forest' AS model, 'GridSearchCV' AS search_type, printf('%.2f', 0.5 + n_nationkey / 100.0)::DOUBLE AS accuracy,
  (400 + s_suppkey % 10)::DOUBLE AS wavenumber, max(s_acctbal) AS importance
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL"""
)
def importance_files(spark, sf):
    """An importance file a nation below a folder a region, ten positions each, united by column name."""
    root = f"{_folder(spark)}/importance"
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy("r_name", "n_nationkey", (400 + F.col("s_suppkey") % 10).alias("pos")).agg(F.max("s_acctbal").alias("value"))
    swapped = F.col("n_nationkey") % 2 == 1  # the order of the columns differs from file to file
    line = F.when(swapped, F.concat_ws(",", "value", "pos")).otherwise(F.concat_ws(",", "pos", "value"))
    head = F.when(swapped, F.lit("Importance,Wavenumber")).otherwise(F.lit("Wavenumber,Importance"))
    files = rows.groupBy("r_name", "n_nationkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # ten at most
    name = F.format_string(
        "%s/wavenumbers_importance_T%d_80pct_Random Forest (GridSearchCV)_acc_%.2f.csv", "r_name", "n_nationkey", 0.5 + F.col("n_nationkey") / 100
    )
    save_named(files.select(name.alias("path"), F.concat_ws("\n", head, "lines").alias("text")), root)
    found, _ = read_importance_files(spark, root)
    facts = ("target_variable", "sample_type", "train_percentage", "model", "search_type", "accuracy")
    return found.select(*facts, F.col("Wavenumber").alias("wavenumber"), F.col("Importance").alias("importance"))


@query(
    """SELECT 'r' || s_suppkey AS run_id, CASE WHEN s_suppkey >= 3 THEN 'r' || s_suppkey % 3 END AS parent_run_id,
  s_name AS run_name, s_suppkey AS start_ms, 'balance' AS key, step AS ts, s_acctbal / (step + 1) AS value, step,
  s_nationkey::VARCHAR AS nation
FROM supplier, (VALUES (0::BIGINT), (1::BIGINT)) t(step)"""
)
def run_store_files(spark, sf):
    """A store with a folder a run, its description, logged values, parameters and the tag of its parent."""
    root, key = f"{_folder(spark)}/runs", F.col("s_suppkey")
    run = F.concat(F.lit("r"), key)
    meta = F.format_string(
        "end_time: %d\nexperiment_id: '1'\nrun_id: r%d\nrun_name: %s\nstart_time: %d\n", key + 1, key, F.col("s_name"), key
    )
    lines = F.concat(F.lit("0 "), "s_acctbal", F.lit(" 0\n1 "), F.col("s_acctbal") / 2, F.lit(" 1\n"))
    parent = F.when(key >= 3, F.concat(F.lit("r"), key % 3))
    one = lambda name, text: F.struct(F.concat_ws("/", run, F.lit(name)).alias("path"), text.alias("text"))
    files = F.array(
        one("meta.yaml", meta),
        one("metrics/balance", lines),
        one("params/nation", F.col("s_nationkey").cast("string")),
        one(f"tags/{PARENT_TAG}", parent),
    )
    rows = table(spark, sf, "supplier").select(F.inline(files)).where("text is not null")
    save_named(rows, root)
    stored = read_run_store(spark, root)
    params = stored["params"].select("run_id", F.col("value").alias("nation"))
    runs = stored["runs"].select("run_id", "parent_run_id", "run_name", "start_ms")
    return runs.join(stored["metrics"], "run_id").join(params, "run_id")


@query(
    """SELECT 'r' || s_suppkey AS run_id, s_nationkey AS nation, s_acctbal AS balance, s_acctbal > 0 AS positive,
  s_suppkey % 7 AS first_cell, NULL::DOUBLE AS f1 FROM supplier"""
)
def split_layout_files(spark, sf):
    """A result file a run in the split layout, all read by one pattern; an absent column is NULL."""
    root, key = f"{_folder(spark)}/results", F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("r"), key).alias("run_id"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
        (F.col("s_acctbal") > 0).alias("positive"),
        F.array(F.array(key % 7, key)).alias("cm"),
    )
    text = to_split_json(rows.columns)
    save_named(rows.select(F.concat("run_id", F.lit("/run_results.json")).alias("path"), text.alias("text")), root)
    schema = "run_id string, nation int, balance double, positive boolean, cm array<array<long>>, f1 double"
    found = read_split_json(spark, f"{root}/*/run_results.json", schema)
    return found.withColumn("first_cell", F.col("cm")[0][0]).drop("cm")
