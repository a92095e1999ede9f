"""Every registered query against its SQL in DuckDB, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from turnlens.plans import catalog, log_queries, stream_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries() | log_queries.queries() | stream_queries.queries(), catalog.oracle_sql() | log_queries.oracle_sql() | stream_queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(frame, columns):
    def plain(v):
        if v is None or str(v) in ("nan", "None", "<NA>", "NaT"):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return None if math.isnan(v) else round(float(v), 9)
        return str(v)

    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
