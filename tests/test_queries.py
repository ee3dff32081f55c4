"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import duckdb
import pytest

from textloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((rounded(r) for r in df.select(*cols).collect()), key=str)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    assert got == sorted((rounded(r) for r in rel.select(", ".join(cols)).fetchall()), key=str)


def test_entry_needs_no_separable_part(spark):
    import __spark_entry__ as e

    assert set(plans.queries()) <= set(e.queries())
    assert e.entry(spark).count() > 0
