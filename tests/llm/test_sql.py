"""Queries with SQL give its rows."""

import duckdb
import pytest

from skein.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_of_the_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    out = con.execute(queries.SQL[name])
    names = [d[0] for d in out.description]
    plain = lambda cols, data: sorted(tuple(round(v, 9) if isinstance(v, float) else v for _, v in sorted(zip(cols, r))) for r in data)
    assert plain(df.columns, df.collect()) == plain(names, out.fetchall())
