"""Exact deduplication: SQL and brute force, state over several batches, weak digests."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lumiframe.llm.exact_dedup import exact_dedup
from lumiframe.llm.queries import ORACLES, QUERIES

ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None), (None, "a"), (7, "A"), (8, "a "), (9, "long " * 30000),
    (10, "long " * 30000), (2, "a"), (None, "only null"), (11, "é"), (12, "é"),
]


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        kept_left = 1
        for d in ids:
            kept = d == keep and kept_left > 0
            kept_left -= kept
            out.append((str(d), str(keep), len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def saved(spark, tmp_path, rows, files=3):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, digest string, n int")
    df.repartition(files).write.parquet(str(tmp_path / "docs.parquet"))
    return str(tmp_path / "docs.parquet")


@pytest.mark.parametrize("files_per_batch", [1, 64])
def test_rows(spark, tmp_path, files_per_batch):
    found = exact_dedup(spark, saved(spark, tmp_path, ROWS), files_per_batch=files_per_batch)
    assert sorted((str(a), str(b), n, k, h) for a, b, n, k, h in found.collect()) == expected(ROWS)


def test_full_bytes_are_checked(spark, tmp_path):
    """A digest of one bit puts unequal texts under one key; the result stays the same."""
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2).substr(2, 1).isin("0", "1", "2").cast("int").cast("string"))
    found = exact_dedup(spark, saved(spark, tmp_path, ROWS), digest=weak, files_per_batch=1)
    assert sorted((str(a), str(b), n, k, h) for a, b, n, k, h in found.collect()) == expected(ROWS)


def test_empty_table(spark, tmp_path):
    assert exact_dedup(spark, saved(spark, tmp_path, [], 1)).collect() == []


def test_query_matches_sql(spark, data):
    name = "op1_exact_dedup"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    df = QUERIES[name](spark, data)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(ORACLES[name]).fetchall())
