"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from starframe.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(records, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == names
    expected = rows((dict(zip(want.columns, r, strict=True)) for r in want.fetchall()), names)
    assert expected
    assert rows((r.asDict() for r in got.collect()), names) == expected
