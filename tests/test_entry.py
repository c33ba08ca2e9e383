"""The entry point, and every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from keelson.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if sql := queries.ORACLE_SQL.get(name):
        assert got == plain(duck.execute(f"select {', '.join(columns)} from ({sql})").fetchall())
    else:
        assert got


def test_upsert_of_parts_numbered_like_regions(spark, tmp_path):
    """A million parts and more have the numbers that regions are added under."""
    con = duckdb.connect()
    con.execute("create table part as select 999998 + i as p_partkey from range(9) t(i)")
    con.execute("create table region as select i as r_regionkey from range(5) t(i)")
    for t in ("part", "region"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = queries.QUERIES["vector_upsert"](spark, str(tmp_path)).select("id", "state")
    want = plain(con.execute(queries.ORACLE_SQL["vector_upsert"]).fetchall())
    assert plain(got.collect()) == want and len(want) == 14
