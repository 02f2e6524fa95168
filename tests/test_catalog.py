"""Every query with SQL against DuckDB, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from chronolith.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})")
    want = sorted(rel.fetchall(), key=repr)
    assert got == want and got
    ints = [c for c, t in df.dtypes if t == "int"]
    assert not ints, "integers are long, as in SQL"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
