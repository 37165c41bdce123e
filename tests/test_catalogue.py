"""Each query with a SQL twin gives what DuckDB gives."""

import math

import duckdb
import pytest

from tidalflow.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "none" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", ["trade_buckets", "features", "residualize_k2", "composites", "pairwise_corr", "block_index", "pending_anti", "upsert", "book_topk", "stream_audit", "bh_fdr", "futures_last", "venue_panels", "collection_state", "cross_bootstrap"])
def test_sql_twin(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLE[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
