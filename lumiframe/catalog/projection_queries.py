"""Partial least squares, back-projection, neighbours and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..operators.backproject import back_project, band_series, first_weights, position_importance
from ..operators.encode import encode
from ..operators.neighbours import nearest_in_class
from ..operators.pls import PLS, cross_products
from ..operators.scale import column_statistics
from ..operators.smote import class_sizes, synthetic_rows
from ..plans.search import permuted_rows
from .registry import query, rounded
from .views import AXIS_SQL, SPECTRA_SQL, TABULAR_SQL, axis, coded_spectra, h_sql, spectra, tabular, u_sql


def pls_sql(long: str, labels: str, key: str, k: int) -> str:
    """CTEs w<a> (pos, v), r<a> (pos, v) for a < k, and z (key, pos, z).

    ``long`` holds (key, pos, x) and ``labels`` (key, y).
    """
    text = f"""stat AS MATERIALIZED (SELECT pos, avg(x) AS m, stddev_samp(x) AS s FROM {long} GROUP BY 1),
z AS MATERIALIZED (SELECT {key}, pos, (x - m) / s AS z FROM {long} JOIN stat USING (pos)),
yz AS MATERIALIZED (SELECT {key}, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM {labels}),
g AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.z * b.z) AS g FROM z a JOIN z b USING ({key}) GROUP BY ALL),
s0 AS MATERIALIZED (SELECT pos, sum(z * y) AS v FROM z JOIN yz USING ({key}) GROUP BY 1)"""
    for a in range(k):
        minus = "".join(
            f" - (SELECT sum(p{b}.v * q.v) FROM p{b} JOIN w{a} q USING (pos))"
            f" * (SELECT v FROM r{b} WHERE r{b}.pos = w{a}.pos)"
            for b in range(a)
        )
        text += f""",
w{a} AS MATERIALIZED (SELECT pos, v / (SELECT sqrt(sum(v * v)) FROM s{a})
  * (SELECT CASE WHEN arg_max(v, abs(v)) > 0 THEN 1 ELSE -1 END FROM s{a}) AS v FROM s{a}),
r{a} AS MATERIALIZED (SELECT pos, v{minus} AS v FROM w{a}),
gr{a} AS MATERIALIZED (SELECT i AS pos, sum(g * v) AS v FROM g JOIN r{a} ON j = pos GROUP BY 1),
t{a} AS MATERIALIZED (SELECT sum(r{a}.v * gr{a}.v) AS tt FROM r{a} JOIN gr{a} USING (pos)),
p{a} AS MATERIALIZED (SELECT pos, v / tt AS v FROM gr{a}, t{a}),
s{a + 1} AS MATERIALIZED (SELECT pos, s.v - p.v * (SELECT sum(r{a}.v * s{a}.v) FROM r{a} JOIN s{a} USING (pos)) AS v
  FROM s{a} s JOIN p{a} p USING (pos))"""
    return text


def _stack(name: str, k: int) -> str:
    return " UNION ALL ".join(f"SELECT {a} AS component, pos, v FROM {name}{a}" for a in range(k))


_PLS = f"WITH {SPECTRA_SQL}, labels AS (SELECT id, code AS y FROM spectra), {pls_sql('long', 'labels', 'id', 10)}"
_TAB = f"""WITH {TABULAR_SQL},
tlong AS (SELECT key, 0 AS pos, x0 AS x FROM tabular UNION ALL SELECT key, 1, x1 FROM tabular UNION ALL SELECT key, 2, x2 FROM tabular),
labels AS (SELECT key, code AS y FROM tabular), {pls_sql('tlong', 'labels', 'key', 2)}"""


@query(
    f"""{_PLS} SELECT i, j, round(g / (SELECT count(*) - 1 FROM spectra), 6) + 0.0 AS value FROM g
UNION ALL SELECT pos, -1, round(v / (SELECT count(*) - 1 FROM spectra), 6) + 0.0 FROM s0"""
)
def correlation_sums(spark, sf):
    """X'X and X'y of standardised columns, over n - 1; j = -1 is the response."""
    sums, _ = cross_products(coded_spectra(spark, sf), "spectrum", "code")
    middle = sums[0, 1:] / sums[0, 0]
    centred = sums[1:, 1:] - sums[0, 0] * middle[:, None] * middle
    deviation = centred.diagonal() ** 0.5
    matrix = centred / deviation[:, None] / deviation
    p = len(matrix) - 1
    rows = [(i, j if j < p else -1, float(matrix[i, j])) for i in range(p) for j in range(p + 1)]
    return spark.createDataFrame(rows, "i int, j int, value double").withColumn("value", rounded("value"))


@query(f"{_PLS} SELECT component, pos, round(v, 6) + 0.0 AS weight FROM ({_stack('w', 10)})")
def pls_weights(spark, sf):
    """M4 M6: ten components."""
    model = PLS(k=10).fit(coded_spectra(spark, sf))
    return model.weights_table(spark).withColumn("weight", rounded("weight"))


@query(
    f"""{_PLS}, r AS ({_stack('r', 10)})
SELECT id, component, round(sum(z * v), 6) + 0.0 AS score FROM z JOIN r USING (pos) GROUP BY ALL"""
)
def pls_scores(spark, sf):
    """M5."""
    rows = coded_spectra(spark, sf)
    scores = unnest(PLS(k=10).fit(rows).transform(rows), ["id"], "scores", "component", "score")
    return scores.withColumn("score", rounded("score"))


@query(
    f"""{_TAB}, r AS ({_stack('r', 2)})
SELECT key, round(sum(z * v) FILTER (component = 0), 6) + 0.0 AS t0, round(sum(z * v) FILTER (component = 1), 6) + 0.0 AS t1
FROM z JOIN r USING (pos) GROUP BY 1"""
)
def pls_scores_tabular(spark, sf):
    """M4 M5 at volume."""
    rows = encode(tabular(spark, sf), "class")[0].select("key", "code", F.array("x0", "x1", "x2").alias("spectrum"))
    scores = PLS(k=2).fit(rows).transform(rows)
    return scores.select("key", *[rounded(F.get("scores", F.lit(i))).alias(f"t{i}") for i in range(2)])


@query(
    f"""WITH {SPECTRA_SQL}, {AXIS_SQL},
stat AS (SELECT sample_type, pos, covar_pop(x, code) / stddev_pop(x) AS s FROM long GROUP BY ALL),
share AS (SELECT sample_type, pos, abs(s) / sum(abs(s)) OVER (PARTITION BY sample_type) AS imp FROM stat),
ranked AS (SELECT sample_type, wavenumber, imp, row_number() OVER (PARTITION BY sample_type ORDER BY imp DESC, pos) AS rank
           FROM share JOIN axis USING (pos) WHERE wavenumber < 1850 OR wavenumber > 2500)
SELECT sample_type, rank::INT AS rank, wavenumber, round(imp, 6) AS importance FROM ranked WHERE rank <= 20"""
)
def separating_positions(spark, sf):
    """Flagship: which wavenumbers separate the classes in each fluid (first weight vector)."""
    weights = first_weights(coded_spectra(spark, sf), "spectrum", "code", ["sample_type"])
    importance = weights.select("sample_type", "pos", F.col("weight").alias("importance"))
    top = back_project(importance, None, axis(spark), by=["sample_type"])
    return top.withColumn("importance", rounded("importance"))


@query(
    f"""{_PLS}, r AS ({_stack('r', 10)}), w AS ({_stack('w', 10)}), {AXIS_SQL},
sc AS (SELECT id, component, sum(z * v) AS score FROM z JOIN r USING (pos) GROUP BY ALL),
imp AS (SELECT sample_type, component, var_pop(score) AS imp FROM sc JOIN spectra USING (id) GROUP BY ALL),
raw AS (SELECT sample_type, pos, abs(sum(imp * v)) AS x FROM imp JOIN w USING (component) GROUP BY ALL),
share AS (SELECT sample_type, pos, x / sum(x) OVER (PARTITION BY sample_type) AS x FROM raw),
ranked AS (SELECT sample_type, wavenumber, x, row_number() OVER (PARTITION BY sample_type ORDER BY x DESC, pos) AS rank
           FROM share JOIN axis USING (pos) WHERE wavenumber < 1850 OR wavenumber > 2500)
SELECT sample_type, rank::INT AS rank, wavenumber, round(x, 6) AS importance FROM ranked WHERE rank <= 20"""
)
def back_projection(spark, sf):
    """The spread of the scores stands for the importance."""
    rows = coded_spectra(spark, sf)
    model = PLS(k=10).fit(rows)
    scores = unnest(model.transform(rows), ["sample_type"], "scores", "component", "score")
    importance = scores.groupBy("sample_type", "component").agg(F.var_pop("score").alias("importance"))
    top = back_project(importance, model.weights_table(spark), axis(spark), by=["sample_type"])
    return top.withColumn("importance", rounded("importance"))


@query(
    f"""WITH {SPECTRA_SQL},
stat AS (SELECT sample_type, pos, stddev_pop(x) AS s FROM long GROUP BY ALL)
SELECT sample_type, pos, round(s / sum(s) OVER (PARTITION BY sample_type), 6) AS importance FROM stat"""
)
def importance_without_projection(spark, sf):
    """Importance that is per position already."""
    stats = column_statistics(spectra(spark, sf), "spectrum", ["sample_type"])
    spread = stats.select("sample_type", "pos", F.col("std").alias("importance"))
    return position_importance(spread, None, ["sample_type"]).withColumn("importance", rounded("importance"))


@query(
    f"""WITH {SPECTRA_SQL}, {AXIS_SQL}
SELECT sample_type, wavenumber, CASE WHEN wavenumber > 2500 THEN 'high' ELSE 'low' END AS band, round(avg(x), 6) + 0.0 AS mean
FROM long JOIN axis USING (pos) WHERE wavenumber < 1850 OR wavenumber > 2500 GROUP BY ALL"""
)
def bands(spark, sf):
    """Mean spectrum in the two bands, descending."""
    stats = column_statistics(spectra(spark, sf), "spectrum", ["sample_type"])
    series = band_series(stats.join(F.broadcast(axis(spark)), "pos"))
    return series.select("sample_type", "wavenumber", "band", rounded("mean").alias("mean"))


_NEAR = """pair AS (SELECT a.code AS label, a.id AS id, b.id AS neighbour, sum((a.x - b.x) * (a.x - b.x)) AS d2
  FROM long a JOIN long b ON a.code = b.code AND a.pos = b.pos AND a.id <> b.id GROUP BY ALL),
near AS (SELECT label, id, neighbour, row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) AS rank FROM pair)"""


@query(f"WITH {SPECTRA_SQL}, {_NEAR} SELECT id, rank::INT AS rank, neighbour FROM near WHERE rank <= 5")
def nearest_neighbours(spark, sf):
    """J8 W6."""
    near = nearest_in_class(coded_spectra(spark, sf), "id", "spectrum", "code", 5)
    return near.select("id", "rank", "neighbour")


@query(f"WITH {SPECTRA_SQL}, {_NEAR} SELECT id, rank::INT AS rank, neighbour FROM near WHERE rank <= 5")
def nearest_neighbours_in_cells(spark, sf):
    """J8 W6 with cells and blocks small enough to be routed."""
    near = nearest_in_class(coded_spectra(spark, sf), "id", "spectrum", "code", 5, cell_rows=40, block_rows=25)
    return near.select("id", "rank", "neighbour")


@query(
    f"""WITH {SPECTRA_SQL}, c AS (SELECT sample_type||':'||group_fam AS label, count(*) AS n FROM spectra GROUP BY 1)
SELECT label, n, max(n) OVER () AS majority, max(n) OVER () - n AS needed FROM c"""
)
def class_balance(spark, sf):
    """A15."""
    rows = spectra(spark, sf).select(F.concat_ws(":", "sample_type", "group_fam").alias("label"))
    return class_sizes(rows, "label")


def _draw(part: str) -> str:
    return f"'52:'||c||':'||j||':{part}'"


_SMOTE = f"""WITH {SPECTRA_SQL}, {_NEAR},
numbered AS (SELECT id, code, row_number() OVER (PARTITION BY code ORDER BY {h_sql("'52:'||id")}, id) - 1 AS no FROM spectra),
sizes AS (SELECT code AS c, count(*) AS n FROM spectra GROUP BY 1),
need AS (SELECT c, n, unnest(range(((SELECT max(n) FROM sizes) - n)::BIGINT)) AS j FROM sizes),
drawn AS (SELECT c, j, {h_sql(_draw('b'))} % n AS no, {h_sql(_draw('n'))} % 5 + 1 AS rank, {u_sql(_draw('u'))} AS u FROM need),
made AS (SELECT c AS code, j, id AS base, neighbour, u FROM drawn JOIN numbered ON c = code AND drawn.no = numbered.no
         JOIN near USING (id, rank))"""


@query(
    f"""{_SMOTE} SELECT made.code, j, base, neighbour, round(u, 6) AS u, a.pos, round(a.x + u * (b.x - a.x), 6) + 0.0 AS value
FROM made JOIN long a ON a.id = base JOIN long b ON b.id = neighbour AND a.pos = b.pos"""
)
def smote_rows(spark, sf):
    """The synthetic rows of all smaller classes."""
    rows = synthetic_rows(coded_spectra(spark, sf), "id", "spectrum", "code")
    keep = ["code", "j", "base", "neighbour", rounded("u").alias("u")]
    return unnest(rows, keep, "spectrum", "pos", "value").withColumn("value", rounded("value"))


@query(
    f"""WITH {TABULAR_SQL},
numbered AS (SELECT key, code, row_number() OVER (PARTITION BY code ORDER BY {h_sql("'52:'||key")}, key) - 1 AS no FROM tabular),
sizes AS (SELECT code AS c, count(*) AS n FROM tabular GROUP BY 1),
need AS (SELECT c, n, unnest(range(((SELECT max(n) FROM sizes) - n)::BIGINT)) AS j FROM sizes),
drawn AS (SELECT c, j, {h_sql(_draw('b'))} % n AS no, {u_sql(_draw('u'))} AS u FROM need)
SELECT c AS code, count(*) AS n, count(DISTINCT key) AS bases, round(avg(u), 4) AS mean_u
FROM drawn JOIN numbered ON c = code AND drawn.no = numbered.no GROUP BY 1"""
)
def smote_tabular(spark, sf):
    """M7 at volume. SQL checks the draws; the neighbours are checked on smaller tables, where all pairs are cheap."""
    rows = encode(tabular(spark, sf), "class")[0].select("key", "code", F.array("x0", "x1", "x2").alias("spectrum"))
    made = synthetic_rows(rows, "key", "spectrum", "code").where(F.col("neighbour").isNotNull())
    return made.groupBy("code").agg(
        F.count("*").alias("n"), F.countDistinct("base").alias("bases"), rounded(F.avg("u"), 4).alias("mean_u")
    )


@query(
    f"""WITH {TABULAR_SQL},
own AS (SELECT key, row_number() OVER (ORDER BY {h_sql("'52:own:'||key")}, key) AS no FROM tabular),
donors AS (SELECT key AS donor, r AS repeat, row_number() OVER (PARTITION BY r ORDER BY {h_sql("'52:'||r||':'||key")}, key) AS no
           FROM tabular, range(2) t(r))
SELECT key, repeat::INT AS repeat, donor FROM own JOIN donors USING (no)"""
)
def permutation_donors(spark, sf):
    """Which row each row takes a value from, a permutation of all rows per repeat."""
    rows = tabular(spark, sf).select("key", F.array("key").alias("own"))
    return permuted_rows(rows, "key", "own", 2, 52).select("key", "repeat", F.col("donor")[0].alias("donor"))
