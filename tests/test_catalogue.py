"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from lectern import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cur = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
