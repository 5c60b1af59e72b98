import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import catalog_queries as Q
from quillon.plans import journal_queries as JQ
from quillon.plans import record_queries as RQ

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, name, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = run(spark, SF).toPandas()
    want = con.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted([*Q.queries(), *JQ.queries(), *RQ.queries()]))
def test_query_equals_sql(spark, name):
    same(spark, name, (Q.queries() | JQ.queries() | RQ.queries())[name], (Q.oracle_sql() | JQ.oracle_sql() | RQ.oracle_sql())[name])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
