"""Registered queries of the corpus operators against their SQL."""

from collections import Counter

import duckdb
import pytest

from pathweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = Counter(tuple(dict(zip(names, r))[c] for c in cols) for r in cursor.fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == want
