"""Every registered query against its SQL, on the smallest tables; rows alone where it has none."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(list(v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, database, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in entry.oracle_sql():
        found = database.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    else:
        assert got  # its rows are held against brute force where it is tested


def test_entry(spark):
    assert entry.entry(spark).count() > 0
