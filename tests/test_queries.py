"""Every registered query against the SQL it is held to."""

import duckdb
import pytest

from palimpsest.plans import catalog, evolving, fixtures, relational, retrieval, texts, written  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(names).collect()]
    cur = db.execute(catalog.SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    expected = [tuple(plain(r[have.index(n)]) for n in names) for r in cur.fetchall()]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
