import os

import duckdb
import pytest

import __spark_entry__ as entry
from kelvane import driver_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_give_what_sql_gives(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert entry.entry(spark).count() > 0
    for name, sql in driver_queries.ORACLE.items():
        df = driver_queries.QUERIES[name](spark, SF)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in df.columns)) for r in got.fetchall())
        assert sorted(repr(tuple(r)) for r in df.collect()) == want, name
