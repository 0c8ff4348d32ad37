"""Every registered query with SQL against the same SQL in another engine."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from pathweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(spark, duck, sf, run, sql):
    df = run(spark, sf)
    cols = sorted(df.columns)
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(dict(zip(names, r))[c]) for c in cols)) for r in cursor.fetchall())
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, sf, name):
    same(spark, duck, sf, registry.queries()[name], registry.oracle_sql()[name])


def test_queries_without_sql(spark, sf):
    """Which rows a sample takes depends on a hash; its sizes have SQL of their own, and that it is a sample is looked at here."""
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"percent_sample"}
    rows = registry.queries()["percent_sample"](spark, sf).collect()
    assert len({r.asn for r in rows}) == len(rows) and 0 < sum(r.implement for r in rows) < len(rows)


def test_entry(spark):
    import __spark_entry__

    assert sum(r.n for r in __spark_entry__.entry(spark).collect()) > 0
