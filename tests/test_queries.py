"""Every registered raster query with SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from rastermill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def text(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = QUERIES[name](spark, SF)
    result = db.sql(ORACLES[name])
    columns = sorted(rows.columns)
    assert columns == sorted(result.columns)
    order = [result.columns.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in rows.collect()) == sorted(tuple(text(r[i]) for i in order) for r in result.fetchall())
