"""Jobs on whole sets of tables, and the command line."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from skein.__main__ import run
from skein.plans import migration
from skein.sources import capture


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def a_run(spark, urls, details, pages):
    return {
        "url_strings": spark.createDataFrame(urls, "id int, url string"),
        "capture_detail": spark.createDataFrame(details, "id int, detail string"),
        "captured_pages": spark.createDataFrame(pages, "locale string, url int, access_time timestamp_ntz, result string, detail int, redir_url int, html_content binary, capture_log binary"),
    }


def test_merge_runs(spark):
    at = datetime(2014, 1, 1)
    one = a_run(spark, [(1, "http://a/"), (2, "http://b/")], [(1, "200 OK")], [("us", 1, at, "ok (redirected)", 1, 2, b"x", b"l"), ("de_home", 2, at, "ok", 1, None, None, None)])
    two = a_run(spark, [(1, "http://b/")], [(1, "200 OK"), (2, "N4")], [("us", 1, at, "timeout", 2, None, b"x", None)])
    t = migration.merge_runs([one, two])
    url = {r.id: r.url for r in t["url_strings"].collect()}
    blob = {r.id: bytes(r.content) for r in t["capture_html_content"].collect()}
    coarse = {r.id: r.result for r in t["capture_coarse_result"].collect()}
    fine = {r.id: (coarse[r.result], r.detail) for r in t["capture_fine_result"].collect()}
    got = sorted((url[r.url], r.country, r.vantage, fine[r.result], url[r.redir_url], blob[r.html_content], r.capture_log is None) for r in t["captured_pages"].collect())
    assert got == [("http://a/", "us", "", ("ok", "200 OK"), "http://b/", b"x", False), ("http://b/", "de", "home", ("ok", "200 OK"), "http://b/", b"", True), ("http://b/", "us", "", ("timeout", "N4"), "http://b/", b"x", True)]
    assert sorted(url.values()) == ["http://a/", "http://b/"] and sorted(blob.values()) == [b"", b"x"]
    assert [r[0] for r in spark.createDataFrame([("Norway (2009; Wikileaks)",), ("x",)], "v string").select(migration.label(F.col("v"))).collect()] == ["Norway 2009 (Wikileaks)", "x"]


def test_copy_sources(spark):
    old = {"url_strings": spark.createDataFrame([(5, "http://z/"), (9, "http://a/"), (7, "http://m/")], "id int, url string"), "urls_b": spark.createDataFrame([(9, 1), (5, 2)], "url int, rank int"), "urls_a": spark.createDataFrame([(5, "x")], "url int, tag string"), "country_codes": spark.createDataFrame([("us",)], "cc2 string"), "captured_pages": spark.createDataFrame([(1,)], "url int")}
    new = migration.copy_sources(old)
    assert set(new) == {"url_strings", "urls_a", "urls_b", "country_codes"}
    assert rows(new["url_strings"]) == [(1, "http://z/"), (2, "http://a/")] and rows(new["urls_b"]) == [(1, 2), (2, 1)] and rows(new["urls_a"]) == [(1, "x")]


def test_statistics_and_reports(spark):
    kind = "id int, segmented array<struct<l:string,t:array<string>>>"
    texts = spark.createDataFrame([(1, [("en", ["a", "b"])]), (2, [("en", ["a"]), ("fr", ["c"])])], kind)
    per_lang, per_text = migration.corpus_statistics(texts)
    stats = {(r["stat"], r.lang): (r.n_documents, r.data) for r in per_lang.collect()}
    assert stats["cwf", "en"] == (2, {"a": 2.0, "b": 1.0}) and stats["idf", "en"][1]["a"] == 0 and stats["rdf", "fr"] == (1, {"c": 1.0})
    assert {(r["stat"], r.text_id) for r in per_text.collect()} == {(s, i) for s in ("tfidf", "nfidf") for i in (1, 2)}
    todo = migration.translation_todo(texts, spark.createDataFrame([("en", "a", "a")], "lang string, word string, engl string"))
    assert rows(todo) == [("en", "b"), ("fr", "c")] and tuple(migration.todo_report(todo).first()) == (2, 2, 2)
    other = spark.createDataFrame([(1, [("en", ["ab"])]), (2, [("en", ["a"]), ("fr", ["c"])])], kind)
    diffs = migration.segment_changes(texts, other, ["en"]).collect()
    assert len(diffs) == 1 and diffs[0].id == 1 and "+en  ab" in diffs[0].diff
    pages = spark.createDataFrame([(1, "http://x.org/a"), (2, "see http://x.org"), (3, ""), (4, "http://x.org/ " + "y" * 600)], "id int, html string")
    assert [r.id for r in migration.url_only_contents(pages).collect()] == [1]
    groups = migration.group_of_urls(spark.createDataFrame([("u", "Alexa 2014"), ("u", "Herdict 2014"), ("v", "Alexa 2014"), ("w", "?")], "url string, source string"))
    assert rows(groups) == [("u", "sensitive"), ("v", "control")]
    bins = spark.createDataFrame([(1, "forbidden (403)", 2), (1, "page not found (404/410)", 3), (1, "parked", 1)], "day int, what string, n int")
    assert rows(migration.changes_by_day(bins)) == [(1, "http error", 5), (1, "parked", 1)]


def test_features(spark):
    kind = "locale string, url string, redir_url string, result string, detail string, html string, text_pruned string, dom_stats struct<tags:map<string,bigint>,tags_at_depth:map<string,bigint>>"
    obs = spark.createDataFrame([("us", "http://a.com/", "http://b.com/", "ok", "200", "<p>x", "x", ({"p": 2, "a": 1}, {"0": 1, "97": 2}))], kind)
    r = migration.feature_matrix(obs).first()
    assert (r.isredir, r.redirdomain, r.html_length, r.content_length, r.n_tags, r.n_kinds, r.n_depths, r.max_depth) == (True, 1, 4, 1, 3, 2, 2, 97)
    assert migration.deep_pages(obs).count() == 1


def test_command_line(spark, tmp_path):
    db = str(tmp_path / "db")
    (tmp_path / "top.csv").write_text("1,example.com\n2,other.org\n")
    (tmp_path / "list.txt").write_text("# Label: L\nhttp://x.org/\n")
    (tmp_path / "cap").mkdir()
    for i, body in enumerate([b"<title>t</title><p>first words here</p>", b"<p>second words</p>"]):
        (tmp_path / f"cap/{i}.us").write_bytes(capture.write_capture(capture.Capture(f"http://h{i}/", "", "200", "OK", 1.0, body, b"")))
    (tmp_path / "tw").mkdir()
    (tmp_path / "tw/1.json").write_text(json.dumps({"id": 1, "user": {"id": 7}, "entities": {"urls": [{"url": "http://t/"}]}}))
    run(["alexa", "--database", db, "--src", str(tmp_path / "top.csv"), "--top-n", "1"], spark)
    run(["staticlist", "--database", db, str(tmp_path / "list.txt")], spark)
    run(["import-batch", "--database", db, str(tmp_path / "cap")], spark)
    run(["extract", "--database", db], spark)
    run(["tfidf", "--database", db], spark)
    run(["twitter", "--database", db, str(tmp_path / "tw"), str(tmp_path / "mark")], spark)
    read = lambda n: spark.read.parquet(f"{db}/ts/{n}")
    assert read("urls_alexa").count() == 4 and read("urls_staticlist").count() == 1 and read("extracted").count() == 2 and read("urls_tweeted").count() == 1
    assert read("corpus_stats").filter("stat = 'rdf'").first()["data"]["words"] == 2.0
