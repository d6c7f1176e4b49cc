"""Every registered query against its SQL in DuckDB; those without SQL have to give stable rows."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(names, data):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    out = duck.execute(registry.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, out.fetchall())


def test_tfidf_by_level_moves_a_documents_words_once(spark, tmp_path):
    docs = [(1, "a b a", "en", "x"), (1, "a c", "de", "x"), (1, "b", "en", None), (2, "a", None, "y"), (None, "c d", "en", "y"), (3, "", "en", "x"), (4, None, "fr", "z"), (5, "d c", "fr", "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, out = registry.QUERIES["tfidf_by_level"](spark, str(tmp_path)), con.execute(registry.SQL["tfidf_by_level"])
    names = [d[0] for d in out.description]
    assert rows(df.columns, df.collect()) == rows(names, out.fetchall())
    # words are counted where their documents are; only to its word's figures a row of words moves
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "hashpartitioning(" in x and "doc_id" in x and "word" in x]


@pytest.mark.parametrize("name", ["html_title", "html_headings"])
def test_cut_references_and_wide_characters_stay_as_in_the_sql(spark, tmp_path, name):
    texts = ["The&amp;&amp;&amp the&amp", "and&am", "a&amp;lt; b &lt;i&gt; &quot;x&quot;", "\ufb01ne \uff21\u00bd", "e\u0301 \u212b", "x\u00a0 y", " \t a\n b ", ""]
    pages = [(i, f"http://h/{i}", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>p</p></body></html>") for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df, out = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.SQL[name])
    names = [d[0] for d in out.description]
    assert rows(df.columns, df.collect()) == rows(names, out.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_is_stable(spark, sf, name):
    first, again = (rows(d.columns, d.collect()) for d in (registry.QUERIES[name](spark, sf) for _ in range(2)))
    assert first and first == again


def test_entry_and_contract(spark):
    assert entry.entry(spark).columns == ["doc_id", "lang", "word", "tf", "tfidf"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
