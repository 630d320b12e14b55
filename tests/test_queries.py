import math

import duckdb
import pytest

import __spark_entry__ as entry
from quadloom.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(plain(r[c]) for c in columns) for r in df.collect())))
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, (tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())))
    assert sorted(names) == columns and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["icon_greedy", "geojson_tiles", "render_tiles"])
def test_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0
