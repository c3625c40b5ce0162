"""Stand-in views over the test tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators.encode import encode

SAMPLE_TYPES = ("CAPILAR", "PLASMA", "SALIVA", "SERUM", "URINE")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def u_sql(text: str) -> str:
    """DuckDB text of the uniform draw."""
    return f"(('0x'||substr(md5({text}),1,8))::BIGINT/4294967296.0::DOUBLE)"


def h_sql(text: str) -> str:
    """DuckDB text of the 32-bit hash."""
    return f"(('0x'||substr(md5({text}),1,8))::BIGINT)"


def axis(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(
        F.col("id").cast("int").alias("pos"), (400.0 + 50.0 * F.col("id")).alias("wavenumber")
    )


AXIS_SQL = "axis AS (SELECT i::INT AS pos, 400.0::DOUBLE + 50.0::DOUBLE * i AS wavenumber FROM range(64) t(i))"


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in SAMPLE_TYPES])
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.get(names, (F.col("vec_id") % 5).cast("int")).alias("sample_type"),
        F.when(F.col("label") >= 8, "A").when(F.col("label") <= 4, "B").otherwise("C").alias("group_fam"),
        F.col("embedding").cast("array<double>").alias("spectrum"),
    )


_TYPES = ",".join(f"'{n}'" for n in SAMPLE_TYPES)
SPECTRA_SQL = f"""spectra AS (
  SELECT vec_id AS id, ([{_TYPES}])[(vec_id % 5 + 1)::INT] AS sample_type,
         CASE WHEN label >= 8 THEN 'A' WHEN label <= 4 THEN 'B' ELSE 'C' END AS group_fam,
         CASE WHEN label >= 8 THEN 0 WHEN label <= 4 THEN 1 ELSE 2 END AS code,
         embedding::DOUBLE[] AS spectrum
  FROM embeddings),
long AS (
  SELECT id, sample_type, group_fam, code, (i - 1)::INT AS pos, spectrum[i] AS x
  FROM spectra, range(1, 65) t(i))"""


def coded_spectra(spark: SparkSession, sf: str) -> DataFrame:
    return encode(spectra(spark, sf), "group_fam")[0]


def spectra_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return spectra(spark, sf).select(
        "id",
        "sample_type",
        F.when(F.col("id") % 47 != 0, F.col("group_fam")).alias("group_fam"),
        F.transform("spectrum", _dirty).alias("spectrum"),
    )


def _dirty(x, i):
    n = F.col("id")
    return (
        F.when((n % 37 == 0) & (i == 0), F.lit(None).cast("double"))
        .when(n % 41 == 0, 0.0)
        .when((n % 43 == 0) & (i == 1), float("nan"))
        .otherwise(x)
    )


DIRTY_SQL = (
    SPECTRA_SQL
    + """,
dirty AS (
  SELECT id, sample_type, CASE WHEN id % 47 <> 0 THEN group_fam END AS group_fam,
         list_transform(spectrum, lambda x, i:
           CASE WHEN id % 37 = 0 AND i = 1 THEN NULL
                WHEN id % 41 = 0 THEN 0.0::DOUBLE
                WHEN id % 43 = 0 AND i = 2 THEN 'NaN'::DOUBLE
                ELSE x END) AS spectrum
  FROM spectra),
checked AS (
  SELECT *, (len(list_filter(spectrum, lambda x: x IS NULL OR isnan(x))) = 0
             AND len(list_filter(spectrum, lambda x: x <> 0)) > 0) AS ok
  FROM dirty)"""
)


def tabular(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    quantity = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("key"),
        F.when(quantity <= 8, "A").when(quantity <= 32, "B").otherwise("C").alias("class"),
        F.col("l_linestatus").alias("grp"),
        F.col("l_extendedprice").alias("x0"),
        F.col("l_discount").alias("x1"),
        F.col("l_tax").alias("x2"),
        "l_returnflag",
        "l_partkey",
        "l_suppkey",
    )


TABULAR_SQL = """tabular AS (
  SELECT l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey||':'||
           round(l_extendedprice*100)::BIGINT AS key,
         CASE WHEN l_quantity <= 8 THEN 'A' WHEN l_quantity <= 32 THEN 'B' ELSE 'C' END AS class,
         CASE WHEN l_quantity <= 8 THEN 0 WHEN l_quantity <= 32 THEN 1 ELSE 2 END AS code,
         l_linestatus AS grp, l_extendedprice AS x0, l_discount AS x1, l_tax AS x2,
         l_returnflag, l_partkey, l_suppkey
  FROM lineitem)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Truth, prediction and probabilities; the probabilities have many ties."""
    flag = F.col("l_returnflag")
    rows = tabular(spark, sf).select(
        "key", "grp", "l_partkey", F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("truth")
    )
    rows = rows.withColumn(
        "wanted", F.when(uniform(F.col("key")) < 0.8, F.col("truth")).otherwise((F.col("truth") + 1) % 3)
    )
    for i in range(3):
        rows = rows.withColumn(f"w{i}", uniform(F.col("key"), i) + F.when(F.col("wanted") == i, 1.0).otherwise(0.0))
    total = F.col("w0") + F.col("w1") + F.col("w2")
    share = [F.floor(F.col(f"w{i}") / total * 1000) / 1000.0 for i in range(3)]
    return rows.select("key", "grp", "l_partkey", "truth", F.col("wanted").alias("pred"), F.array(*share).alias("proba"))


_W = ", ".join(
    f"{u_sql(f'''key||':{i}' ''')} + CASE WHEN pred = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w{i}" for i in range(3)
)
_P = ", ".join(f"floor(w{i}/(w0+w1+w2)*1000)/1000.0::DOUBLE" for i in range(3))
SCORED_SQL = (
    TABULAR_SQL
    + f""",
truths AS (
  SELECT key, grp, l_partkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS truth FROM tabular),
wanted AS (
  SELECT *, CASE WHEN {u_sql("key")} < 0.8 THEN truth ELSE (truth + 1) % 3 END AS pred FROM truths),
weighed AS (SELECT *, {_W} FROM wanted),
scored AS (SELECT key, grp, l_partkey, truth, pred, [{_P}] AS proba FROM weighed)"""
)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    acc = (F.col("o_orderkey") * 7919 % 1000) / F.lit(1000.0)
    days = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("parent_run_id"),
        F.col("o_orderpriority").alias("run_name"),
        F.col("o_orderstatus").alias("sample_type"),
        F.col("o_orderpriority").alias("model_type"),
        acc.alias("acc"),
        F.when(F.col("o_orderkey") % 97 == 0, float("nan"))
        .when(F.col("o_orderkey") % 89 != 0, (F.col("o_orderkey") * 104729 % 1000) / F.lit(1000.0))
        .alias("f1"),
        (days * 86400000).alias("start_ms"),
    )


RUN_LOG_SQL = """run_log AS (
  SELECT o_orderkey AS run_id, o_custkey AS parent_run_id, o_orderpriority AS run_name,
         o_orderstatus AS sample_type, o_orderpriority AS model_type,
         (o_orderkey*7919 % 1000)::DOUBLE/1000.0::DOUBLE AS acc,
         CASE WHEN o_orderkey % 97 = 0 THEN 'NaN'::DOUBLE
              WHEN o_orderkey % 89 <> 0 THEN (o_orderkey*104729 % 1000)::DOUBLE/1000.0::DOUBLE END AS f1,
         date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT*86400000 AS start_ms
  FROM orders)"""


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """One experiment configuration per customer with orders."""
    texts = lambda *v: F.array(*[F.lit(x) for x in v])
    statuses = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_set("o_orderstatus")).alias("sample_types")
    )
    customer = F.col("o_custkey")
    return statuses.select(
        customer.alias("experiment"),
        texts("grid", "bayes").alias("searchs_hipermetrics"),
        texts("random_forest", "mlp_classifier", "decision_tree", "xgboost").alias("model_types_to_train"),
        texts(0.8, 0.7, 0.6).alias("train_percentages"),
        "sample_types",
        texts("group_fam").alias("targets_to_predict"),
        texts(True).alias("scale"),
        F.when(customer % 7 == 0, texts(False)).otherwise(texts(True)).alias("apply_pls"),
        texts(True).alias("apply_smote_resampling"),
        texts(10).alias("n_components"),
    )


SETTINGS_SQL = """configs AS (
  SELECT o_custkey AS experiment, list_sort(list(DISTINCT o_orderstatus)) AS sample_types FROM orders GROUP BY 1),
settings AS (
  SELECT experiment,
         (((s.i - 1) * 4 + (m.i - 1)) * 3 + (p.i - 1)) * len(sample_types) + (t.i - 1) AS position,
         (['grid','bayes'])[s.i] AS search_to_use,
         (['random_forest','mlp_classifier','decision_tree','xgboost'])[m.i] AS model_type,
         ([0.8::DOUBLE,0.7::DOUBLE,0.6::DOUBLE])[p.i] AS train_percentage,
         sample_types[t.i] AS sample_type, 'group_fam' AS target, true AS scale,
         experiment % 7 <> 0 AS apply_pls, true AS apply_smote_resampling,
         CASE WHEN experiment % 7 <> 0 THEN 10 END AS n_components
  FROM configs, range(1, 3) s(i), range(1, 5) m(i), range(1, 4) p(i), range(1, 4) t(i)
  WHERE t.i <= len(sample_types)),
named AS (
  SELECT * REPLACE (
    CASE search_to_use WHEN 'grid' THEN 'GridSearchCV' ELSE 'BayesSearchCV' END AS search_to_use,
    CASE model_type WHEN 'random_forest' THEN 'Random Forest' WHEN 'mlp_classifier' THEN 'MLP'
                    WHEN 'decision_tree' THEN 'Decision Tree' ELSE 'XGBoost' END AS model_type)
  FROM settings)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of importance files, some malformed, one per order."""
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    sample = F.get(F.array(*[F.lit(n) for n in SAMPLE_TYPES]), (k % 5).cast("int"))
    model = F.get(F.array(F.lit("Random Forest"), F.lit("MLP"), F.lit("XGBoost")), (k % 3).cast("int"))
    search = F.when(k % 2 == 0, "GridSearchCV").otherwise("BayesSearchCV")
    percent = F.get(F.array(F.lit("80"), F.lit("70"), F.lit("57.5")), (k % 3).cast("int"))
    acc = F.concat(F.lit("0."), F.lpad((k * 7919 % 1000).cast("string"), 3, "0"))
    name = F.concat(
        F.lit("/data/target "),
        (k % 7).cast("string"),
        F.lit("/wavenumbers_importance_"),
        sample,
        F.lit("_"),
        percent,
        F.lit("pct_"),
        F.concat(model, F.lit(" ("), search, F.lit(")")),
        F.when(k % 50 == 0, "").otherwise("_test"),
        F.lit("_"),
        acc,
        F.lit(".csv"),
    )
    return orders.select("o_orderkey", name.alias("path"))


PATHS_SQL = f"""paths AS (
  SELECT o_orderkey, '/data/target '||(o_orderkey % 7)||'/wavenumbers_importance_'||
    ([{_TYPES}])[(o_orderkey % 5 + 1)::INT]||'_'||(['80','70','57.5'])[(o_orderkey % 3 + 1)::INT]||'pct_'||
    (['Random Forest','MLP','XGBoost'])[(o_orderkey % 3 + 1)::INT]||' ('||
    CASE WHEN o_orderkey % 2 = 0 THEN 'GridSearchCV' ELSE 'BayesSearchCV' END||')'||
    CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE '_test' END||
    '_0.'||lpad((o_orderkey*7919 % 1000)::VARCHAR, 3, '0')||'.csv' AS path
  FROM orders)"""
