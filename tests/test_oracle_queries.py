"""Every registered query with a SQL twin, against DuckDB on sf0.001
(the driver's gate runs the same comparison at sf0.01)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as se
from tests.conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SLOW = {"cluster_texts", "cluster_texts_stats", "cluster_scores", "assign_cluster", "truncated_svd"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_sql_twin(spark, con, name):
    sdf = se.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    srows = Counter(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    res = con.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = Counter(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert srows == drows


@pytest.mark.parametrize("name", sorted(set(se.queries()) - set(se.oracle_sql()) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert se.queries()[name](spark, SF001).count() > 0


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert sorted(r["rank"] for r in rows) == list(range(len(rows)))
    assert set(df.columns) >= {"rank", "cluster", "mean", "median", "size", "metric"}
