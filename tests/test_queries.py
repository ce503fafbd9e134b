"""Every registered query of the main package against its SQL twin on DuckDB."""

import math
import os

import duckdb
import pytest

from tidemark.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = [r.asDict() for r in df.collect()]
    found = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    rows = [dict(zip(cols, r, strict=True)) for r in found.fetchall()]
    key = lambda r: repr([(c, plain(r[c])) for c in sorted(cols)])
    assert sorted(map(key, got)) == sorted(map(key, rows))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"classifier_metrics"}))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
