"""Scan, selection, labels, split, folds and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..operators import select as sel
from ..operators.encode import decode, dictionary_of, encode
from ..operators.scale import PopulationScaler, column_statistics
from ..operators.split import stratified_folds, stratified_split
from ..sources.wide import pack
from .registry import query, rounded
from .views import (
    DIRTY_SQL,
    SPECTRA_SQL,
    TABULAR_SQL,
    h_sql,
    spectra,
    spectra_dirty,
    tabular,
)


@query(
    f"""WITH {TABULAR_SQL}
SELECT key, 0 AS pos, 400.5::DOUBLE AS wavenumber, x0 AS value FROM tabular
UNION ALL SELECT key, 1, 1850.25::DOUBLE, x1 FROM tabular
UNION ALL SELECT key, 2, 2500::DOUBLE, x2 FROM tabular"""
)
def pack_wide_table(spark, sf):
    """The columns that are not descriptive become one array and an axis."""
    rows = tabular(spark, sf)
    wide = rows.select("key", "grp", *[F.col(c).alias(n) for c, n in (("x0", "400.5"), ("x1", "1850.25"), ("x2", "2500"))])
    packed, axis = pack(wide, ["key", "grp"])
    return packed.select("key", F.posexplode("spectrum").alias("pos", "value")).join(F.broadcast(axis), "pos")


@query(f"WITH {DIRTY_SQL} SELECT id, group_fam FROM checked WHERE sample_type = 'SERUM' AND group_fam IS NOT NULL AND ok")
def select_valid_samples(spark, sf):
    """P4 P9."""
    return sel.select_samples(spectra_dirty(spark, sf), "group_fam", "SERUM").select("id", "group_fam")


@query(f"WITH {DIRTY_SQL} SELECT id, sample_type FROM checked WHERE sample_type = 'URINE' AND group_fam = 'B' AND ok")
def select_one_group(spark, sf):
    """P5."""
    return sel.select_samples(spectra_dirty(spark, sf), "id", "URINE", group="B").select("id", "sample_type")


@query(f"WITH {DIRTY_SQL} SELECT id, 1.0::DOUBLE AS vo2max FROM checked WHERE sample_type = 'PLASMA' AND ok")
def select_absent_target(spark, sf):
    """P7."""
    return sel.select_samples(spectra_dirty(spark, sf), "vo2max", "PLASMA").select("id", "vo2max")


@query(
    f"""WITH {DIRTY_SQL}
SELECT sample_type, count(*) AS n_rows, count(group_fam) AS n_target,
       count(*) FILTER (ok AND group_fam IS NOT NULL) AS n_valid,
       bool_and(ok AND group_fam IS NOT NULL) AS all_valid, bool_or(ok AND group_fam IS NOT NULL) AS any_valid
FROM checked GROUP BY 1"""
)
def validation_report(spark, sf):
    """P6 P8 P9 A19."""
    return sel.validation_report(spectra_dirty(spark, sf), "group_fam", ["sample_type"])


@query(f"WITH {TABULAR_SQL} SELECT grp, count(*) AS n, count(DISTINCT class) AS classes FROM tabular GROUP BY 1")
def column_contract(spark, sf):
    """The column set is checked, the order is free."""
    rows = tabular(spark, sf)
    same = sel.require_same_columns(rows.select(*reversed(rows.columns)), rows.columns)
    return same.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("class").alias("classes"))


@query(
    f"""WITH {DIRTY_SQL},
d AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
      FROM (SELECT DISTINCT group_fam AS value FROM dirty WHERE group_fam IS NOT NULL))
SELECT id, coalesce(d.code, -1)::INT AS code FROM dirty LEFT JOIN d ON group_fam = value"""
)
def encode_labels(spark, sf):
    """M1 F16: missing labels get -1."""
    return encode(spectra_dirty(spark, sf), "group_fam")[0].select("id", "code")


@query(
    """SELECT l_partkey AS value, (row_number() OVER (ORDER BY l_partkey) - 1)::INT AS code
FROM (SELECT DISTINCT l_partkey FROM lineitem)"""
)
def label_dictionary(spark, sf):
    """Numbers are coded in numeric order."""
    return dictionary_of(tabular(spark, sf), "l_partkey")


@query(
    """WITH d AS (SELECT value, (row_number() OVER (ORDER BY value) - 1)::INT AS code
  FROM (SELECT DISTINCT o_orderkey AS value FROM orders))
SELECT o_orderkey, code FROM orders JOIN d ON o_orderkey = value"""
)
def encode_many_labels(spark, sf):
    """M1 with one label an order."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return encode(orders, "o_orderkey")[0]


@query(f"WITH {TABULAR_SQL} SELECT class AS label, code, count(*) AS n FROM tabular GROUP BY ALL")
def decode_labels(spark, sf):
    """M1 decode."""
    coded, dictionary = encode(tabular(spark, sf), "class")
    return decode(coded.drop("class"), dictionary).groupBy("label", "code").agg(F.count("*").alias("n"))


def _split_sql(source: str, key: str, label: str, fraction: float, seed: int) -> str:
    """Rows with is_train: ceil test size, largest remainder, hash order."""
    order = h_sql(f"'{seed}:'||{key}")
    return f"""counts AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
total AS (SELECT sum(n) AS n, sum(n) - ceil((1 - {fraction}::DOUBLE) * sum(n)) AS n_train FROM counts),
shares AS (SELECT c, counts.n / total.n * n_train AS exact, n_train FROM counts, total),
sized AS (SELECT c, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, c)
                 <= n_train - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS size FROM shares),
split AS (SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY {order}, {key}) <= size AS is_train
          FROM {source} s JOIN sized ON {label} = c)"""


@query(f"WITH {TABULAR_SQL}, {_split_sql('tabular', 'key', 'class', 0.7, 52)} SELECT key, class, is_train FROM split")
def split_tabular(spark, sf):
    """M2 W1 at volume."""
    return stratified_split(tabular(spark, sf).select("key", "class"), "key", "class", 0.7)


@query(f"WITH {SPECTRA_SQL}, {_split_sql('spectra', 'id', 'group_fam', 0.8, 7)} SELECT id, group_fam, is_train FROM split")
def split_spectra(spark, sf):
    """M2 W1 with another seed."""
    return stratified_split(spectra(spark, sf).select("id", "group_fam"), "id", "group_fam", 0.8, seed=7)


def _folds_sql(source: str, key: str, label: str, order: str, k: int = 5) -> str:
    """Fold of each row: the sorted labels are dealt in turn, a class fills its folds in order."""
    return f"""counts AS (SELECT {label} AS c, count(*) AS n FROM {source} GROUP BY 1),
starts AS (SELECT c, n, coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM counts),
dealt AS (SELECT c, i AS fold, floor((s + n + {k} - 1 - i) / {k}) - floor((s + {k} - 1 - i) / {k}) AS size
          FROM starts, range({k}) t(i)),
upto AS (SELECT c, fold, size, sum(size) OVER (PARTITION BY c ORDER BY fold) AS hi FROM dealt),
placed AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS r FROM {source})
SELECT p.{key}, p.{label}, fold::INT AS fold FROM placed p JOIN upto ON {label} = c AND r <= hi AND r > hi - size"""


@query(f"WITH {TABULAR_SQL}, {_folds_sql('tabular', 'key', 'class', h_sql("'52:'||key") + ', key')}")
def folds_shuffled(spark, sf):
    """W2 with a seed."""
    return stratified_folds(tabular(spark, sf).select("key", "class"), "key", "class", 5, seed=52)


@query(f"WITH {SPECTRA_SQL}, {_folds_sql('spectra', 'id', 'group_fam', 'id')}")
def folds_in_order(spark, sf):
    """W2 in input order."""
    return stratified_folds(spectra(spark, sf).select("id", "group_fam"), "id", "group_fam", 5)


@query(
    f"""WITH {SPECTRA_SQL}
SELECT sample_type, pos, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std FROM long GROUP BY 1, 2"""
)
def column_statistics_by_type(spark, sf):
    """A10."""
    stats = column_statistics(spectra(spark, sf), "spectrum", ["sample_type"])
    return stats.select("sample_type", "pos", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(
    f"""WITH {SPECTRA_SQL}, {_split_sql('spectra', 'id', 'group_fam', 0.8, 52)},
m AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM long JOIN split USING (id) WHERE is_train GROUP BY 1)
SELECT id, pos, round((x - mean) / std, 6) + 0.0 AS z FROM long JOIN m USING (pos)"""
)
def scale_spectra(spark, sf):
    """Fitted on the training rows, applied to all."""
    rows = stratified_split(spectra(spark, sf), "id", "group_fam", 0.8)
    model = PopulationScaler().fit(rows.where("is_train"))
    scaled = unnest(model.transform(rows), ["id"], "scaled", "pos", "z")
    return scaled.withColumn("z", rounded("z"))


@query(
    f"""WITH {TABULAR_SQL},
m AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM tabular)
SELECT key, round((x0 - m0) / s0, 6) + 0.0 AS z0, round((x1 - m1) / s1, 6) + 0.0 AS z1,
       round((x2 - m2) / s2, 6) + 0.0 AS z2, 0.0::DOUBLE AS z3 FROM tabular, m"""
)
def scale_tabular(spark, sf):
    """M3 at volume; a constant position keeps x - mean."""
    rows = tabular(spark, sf).select("key", F.array("x0", "x1", "x2", F.lit(5.0)).alias("spectrum"))
    scaled = PopulationScaler().fit(rows).transform(rows)
    return scaled.select("key", *[rounded(F.get("scaled", F.lit(i))).alias(f"z{i}") for i in range(4)])


