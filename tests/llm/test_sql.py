"""The operators' queries against their SQL."""

import duckdb
import pytest

from tessera.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    q = queries.queries()[name](spark, sf)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(q.columns) == sorted(names)
    got = sorted(tuple(str(r[c]) for c in sorted(names)) for r in q.collect())
    assert got == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
