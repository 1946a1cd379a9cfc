"""Every query outside llm against its SQL, over whole tables of the smallest scale."""

import duckdb
import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if v is None or v != v:
        return "null"
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def test_each_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cur = db.execute(registry.SQL[name])
    want_cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(want_cols)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    at = [want_cols.index(c) for c in sorted(want_cols)]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
