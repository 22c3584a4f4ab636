import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(catalog.ORACLE_SQL)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    text = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(text(v) for _, v in sorted(zip(names, row))) for row in sql.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
