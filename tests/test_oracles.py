"""Every registered query of the claims part against its SQL on DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from claimstead.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    result = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    got, want = rows(df.columns, df.collect()), rows(result.columns, result.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_ann_recall_passes_the_gates(spark, sf_dir):
    rows_ = registry.vector_ann_recall(spark, sf_dir).collect()
    assert {r["scenario"] for r in rows_} == {"broad", "medium", "narrow"}
    assert all(r["mean_recall"] >= 0.95 and r["min_recall"] >= 0.9 for r in rows_)


def test_stream_equals_rebuild(spark, sf_dir):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(registry.projection_sync(spark, sf_dir)) == key(registry.projection_rebuild(spark, sf_dir))
