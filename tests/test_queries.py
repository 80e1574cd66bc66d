"""Every registered catalog query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from shelfwise import catalog_queries, entity_queries, feed_queries, import_queries, service_queries, shopping_queries, text_queries  # noqa: F401  (they register their queries)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def norm(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    try:
        f = float(v) if not isinstance(v, str) else None
    except (TypeError, ValueError):
        f = None
    return str(v) if f is None else f"{f:.6f}".rstrip("0").rstrip(".")


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query(spark, duck, name):
    df = catalog_queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in catalog_queries.ORACLES:
        assert got
        return
    res = duck.execute(catalog_queries.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(row[names.index(c)]) for c in cols) for row in res.fetchall())


def test_entry_points_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog_queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_filters_and_columns_reach_the_scan(spark):
    from shelfwise import plans

    plan = plans.products(spark, FOLDER).filter("brand = 'Brand#1'").select("ean")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_brand,Brand#1)" in plan and "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in plan
