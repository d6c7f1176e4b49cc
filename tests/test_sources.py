"""Readers on hand-written files, capture files, traces and streams."""

import json
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skein.sources import capture, lists, traces
from skein.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


# Captures


@pytest.mark.parametrize("version", [0, 1])
def test_capture_round_trip(version):
    c = capture.Capture("http://a/", "http://b/", "200", "OK", 1.5, b"<p>", b"", version)
    data = capture.write_capture(c)
    assert capture.read_capture(data) == c and data.startswith(b"\x7fcap 0%d\n" % version)


def test_read_capture_folder(spark, tmp_path):
    good = capture.Capture("http://a/", "", "200", "OK", 1.5, "é".encode(), b"log")
    put(tmp_path / "00/000/001.us_home", capture.write_capture(good))
    put(tmp_path / "00/000/002.de", capture.write_capture(good)[:-1])
    put(tmp_path / "00/000/003.fr", b"nothing")
    out = {r.country: r for r in capture.read_captures(spark, str(tmp_path)).collect()}
    assert (out["us"].vantage, out["us"].redir_url, out["us"].error, bytes(out["us"].content).decode()) == ("home", "http://a/", None, "é")
    assert out["de"].error and out["fr"].error == "not a capture file"
    assert "http://a/" in capture.dump(capture.read_captures(spark, str(tmp_path)).filter("error is null")).first().text


def test_write_captures(spark, tmp_path):
    df = spark.createDataFrame([(1234567, "us", "http://a/", "http://a/", "200", "OK", 1.0, b"x", b"y")], "serial int, locale string, url string, redir_url string, status string, detail string, elapsed double, content binary, log binary")
    capture.write_captures(df, str(tmp_path))
    assert capture.shard_path(1234567, "us") == "01/234/567.us"
    assert capture.read_capture((tmp_path / "01/234/567.us").read_bytes()).content == b"x"


def test_sqlite_pages(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE samples_html_content (url, date, html_content)")
        db.executemany("INSERT INTO samples_html_content VALUES (?, ?, ?)", [("http://a/", "2014-01-02", "é".encode()), ("http://b/", "bad", b"\xe9")])
    out = rows(capture.read_sqlite_pages(spark, str(tmp_path / "s.db")))
    assert [(r[0], r[2]) for r in out] == [("http://a/", "é"), ("http://b/", "é")] and out[1][1] is None


# Lists


def test_ranked_sites(spark, tmp_path):
    p = put(tmp_path / "top.csv", "1,example.com\n2,www.x.org/a\n3,example.com\n")
    out = {r.url: r["rank"] for r in lists.ranked_sites(spark, p).collect()}
    assert out["http://example.com/"] == 1 and out["https://www.x.org/a"] == 2 and lists.ranked_sites(spark, p, top_n=1).count() == 4


def test_category_lists(spark, tmp_path):
    for name in ("us", "global", "cis", "00-LEGEND", "usa"):
        put(tmp_path / f"{name}.csv", "url,category_code\nHTTP://A.com,NEWS\n")
    df = lists.category_lists(spark, str(tmp_path))
    assert rows(df) == [("http://a.com/", "US", "NEWS"), ("http://a.com/", "XC", "NEWS"), ("http://a.com/", "ZZ", "NEWS")]
    assert rows(lists.category_lists(spark, str(tmp_path), spark.createDataFrame([("US",)], "country string"))) == [("http://a.com/", "XC", "NEWS"), ("http://a.com/", "ZZ", "NEWS")]
    legend = put(tmp_path / "l/legend.csv", "CategoryCode,CategoryName\nA,Anon\nB,Blog\n")
    assert rows(lists.category_legend(spark, legend, spark.createDataFrame([("A", "Anon")], "code string, description string"))) == [("B", "Blog")]
    with pytest.raises(ValueError):
        lists.category_legend(spark, put(tmp_path / "l/bad.csv", "x,y\n1,2\n"))


def test_json_sources(spark, tmp_path):
    reports = [{"url": "A.com", "reportDate": "2014-02-03T04:05:06+0000", "reportType": "INACCESSIBLE"}, {"url": "https://b.com/x", "reportDate": "2015-02-03T04:05:06+0000", "reportType": "ACCESSIBLE", "protocol": "HTTPS", "country": {"shortName": "FR"}}]
    p = put(tmp_path / "r.json", json.dumps(reports))
    df = lists.access_reports(spark, p)
    assert sorted((r.url, r.accessible, r.country) for r in df.collect()) == [("http://a.com/", False, "??"), ("https://b.com/x", True, "FR")]
    assert lists.access_reports(spark, p, "2014-06-01").count() == 1 and lists.report_totals(df).first()["total"] == 2
    b = put(tmp_path / "b.json", json.dumps([{"href": "http://X/", "time": "2014-01-01T00:00:00Z", "description": "t", "extended": "", "tags": "a b"}] * 2))
    assert lists.bookmarks(spark, b, "me").count() == 1
    w = put(tmp_path / "w.json", json.dumps({"query": {"pages": {"1": {"title": "P", "extlinks": [{"*": "http://l/"}]}, "-1": {"title": "Q", "missing": ""}}}}))
    assert rows(lists.wiki_extlinks(spark, w)) == [("P", "http://l/", False), ("Q", None, True)]
    c = put(tmp_path / "c.json", json.dumps({"data": [["<a href=x>d.com</a>", "03.02.2014", "ag", "no"]]}))
    r = lists.court_table(spark, c).first()
    assert (r.domain, str(r.date)) == ("d.com", "2014-02-03")


def test_text_lists(spark, tmp_path):
    s = put(tmp_path / "s.txt", "# Label: L\n# Source: S\n# Date: 2014-05-06\nhttp://A/\nexample.com\nftp://no/\n\n")
    out = lists.static_list(spark, s).collect()
    assert {r.url for r in out} == {"http://a/", "http://www.example.com/", "https://www.example.com/", "http://example.com/", "https://example.com/"} and {(r.label, str(r.date)) for r in out} == {("L", "2014-05-06")}
    leak = lists.leak_list(spark, put(tmp_path / "l.txt", "# Country: X\nhttp://a/\nb.org\n")).collect()
    assert sorted(r.url for r in leak) == ["http://a/", "http://b.org/", "http://www.b.org/"] and leak[0].meta == {"country": "X"}
    orders = lists.court_orders(spark, put(tmp_path / "o.csv", "domain,date,agency,caseno\na.com,2014,x,1\nwww.b.com,2014,y,2\n")).collect()
    assert sorted(r.url for r in orders) == ["http://a.com/", "http://www.a.com/", "http://www.b.com/"] and json.loads(orders[0].meta)["date"] == "2014"
    blocked = put(tmp_path / "b.csv", "http://a/,1,2,3,blocked,5,6,7,Porn\nhttp://a/,1,2,3,blocked,5,6,7,chat\nhttp://b/,1,2,3,ok,5,6,7,x\n")
    assert rows(lists.blocked_tags(spark, blocked, {"chat": ["social", "chat"]})) == [("http://a/", "chat|porn|social")]
    proxy = put(tmp_path / "p.log", "3 policy_denied http://A/x\n1 observed http://b/\nx policy_denied http://c/\n2 policy_denied http://d/i.gif\nbroken\n")
    assert rows(lists.proxy_sample(spark, proxy)) == [(3, "http://a/x")]
    wiki = put(tmp_path / "links-fr.csv", "page,link\nA b,http://x.org\nC,nothing\n")
    assert rows(lists.wiki_links(spark, wiki)) == [("fr", "A b", "https://fr.wikipedia.org/wiki/A_b", "http://x.org/")]
    merged = put(tmp_path / "m.csv", "a,http://z/,\"http://B/\"\nhttp://b/\nhttp://x/i.png\n")
    assert [r.url for r in lists.merged_lists(spark, merged).collect()] == ["http://b/", "http://z/"]
    index = put(tmp_path / "i.txt", "http://a/ 20100102030405 200\nhttp://a/ 20100102030405 404\nhttp://a/ bad 200\nshort\n")
    assert [(r.url, r.time.isoformat()) for r in lists.archive_index(spark, index).collect()] == [("http://a/", "2010-01-02T03:04:05")]
    hosts = put(tmp_path / "h.txt", "# c\nb.org (1.2.3.4)\na.com\nbad..name\nBücher.de # x\n")
    assert [(r.name, r.address) for r in lists.hostnames(spark, hosts).collect()] == [("a.com", None), ("xn--bcher-kva.de", None), ("b.org", "1.2.3.4")]
    assert rows(lists.dns_servers(spark, put(tmp_path / "d.txt", "us 1.2.3.4 8.8.8.8 # g\n"))) == [("us", ["1.2.3.4", "8.8.8.8"])]
    with pytest.raises(PySparkException):
        lists.dns_servers(spark, put(tmp_path / "d2.txt", "us nothing\n")).collect()
    assert rows(lists.proxy_config(spark, put(tmp_path / "c.txt", "us direct\nde_x ovpn a b\n"))) == [("de_x", "ovpn", ["a", "b"]), ("us", "direct", [])]
    with pytest.raises(PySparkException):
        lists.proxy_config(spark, put(tmp_path / "c2.txt", "us a\nus b\n")).collect()
    put(tmp_path / "t/1/fr.csv", "word,engl\nchat,cat\nx,&amp;\n"), put(tmp_path / "t/2/fr.csv", "word,engl\nchat,kitty\n")
    assert rows(lists.translations(spark, str(tmp_path / "t/*"))) == [("fr", "chat", "kitty"), ("fr", "x", "&")]
    assert rows(lists.stop_words(spark, put(tmp_path / "stop.txt", "The\nof\n\nthe\n"))) == [("of",), ("the",)]
    assert lists.url_lines(spark, s).count() == 6 and rows(lists.rescan(spark, put(tmp_path / "rs.csv", "url,result,locales\nhttp://a/,ok,us de\n"))) == [("http://a/", "ok", "us de")]
    assert rows(lists.size_clusters(spark, put(tmp_path / "sc.csv", "us,x,10:2;20:3\n"))) == [("us", 10, 2), ("us", 20, 3)]
    assert lists.public_suffixes(spark, put(tmp_path / "ps.txt", "com\n// x\nco.uk\n")) == {"com", "co.uk"}
    assert lists.dimension(spark, [("a", 1)], "k string, v int", ["k"]).count() == 1
    with pytest.raises(ValueError):
        lists.dimension(spark, [("a", 1), ("a", 2)], "k string, v int", ["k"])
    assert lists.run_tables(spark, "default", "no_such_") == []


# Traces


def test_hops(spark, tmp_path):
    text = "tracelb from me to there, x\n* -> (a, b) -> *\n* -> there\ntracelb from me to z,\nq -> r\n"
    want = [("me", "there", "me", "a"), ("me", "there", "me", "b"), ("me", "there", "a", "*2"), ("me", "there", "b", "*2"), ("me", "there", "*2", "there"), ("me", "z", "q", "r")]
    assert traces.hop_edges(text) == want
    assert traces.traceroutes(spark, put(tmp_path / "t.txt", text)).count() == 6


def test_logs_and_records(spark, tmp_path):
    log = "0.0 worker us using port 5001\n1.0 start (1, 'http://a/')\n2.5 stop (1, 'http://a/')\n3 start (2, 'http://b/')\n4 stop (2, 'http://c/')\nnoise\n"
    assert rows(traces.worker_log(spark, put(tmp_path / "w.log", log))) == [(5001, 1.0, 2.5, "http://a/")]
    rec = traces.tls_records(spark, put(tmp_path / "r.txt", "   1 u 22 3.1  517  0.25\nbad\n   1 d 22 3.1 1000  1.75\n"))
    assert rows(rec) == [(1, "d", 22, "3.1", 1000, 1.75), (1, "u", 22, "3.1", 517, 0.25)]
    assert rows(traces.record_gaps(rec.withColumn("ts", F.col("dt"))).select("gap")) == [(None,), (None,)]


def test_baselines(spark, tmp_path):
    data = {"meta": {"foo": "bar"}, "baseline": [{"other": 1, "dns": {"h": [{"request": "q", "response1": "x", "response1-ips": ["192.0.2.1"], "nameserver": "8.8.8.8"}]},
        "http": {"http://a/": {"response": {"status": 200, "reason": "OK", "body": "B"}, "redirects": {"0": {"request": {"url": "http://z/"}, "response": {"status": 301, "body": "B"}}, "1": {"response": {"reason": "odd"}}}}, "http://f/": {"response": {"failure": "timed out"}}}}]}
    df = traces.baseline(spark, put(tmp_path / "b.json", json.dumps(data)))
    assert rows(traces.baseline_meta(df)) == [("foo", "bar")] and rows(traces.baseline_dns(df)) == [("h", "8.8.8.8", "192.0.2.1")] and traces.baseline_dns(df, raw=True).count() == 1
    assert rows(traces.baseline_http(df)) == sorted([("http://a/", "0", "http://z/", "301", None), ("http://a/", "1", "http://a/", "??? odd", None), ("http://a/", "t", "http://a/", "200 OK", "B"), ("http://f/", "t", "http://f/", "timed out", None)], key=repr)


def test_ip_countries_and_har(spark):
    hops = spark.createDataFrame([("1.2.3.4",), ("9.9.9.9",), ("no",)], "ip string")
    ranges = spark.createDataFrame([(16909056, 16909312, "AU")], "lo long, hi long, country string")
    assert rows(traces.ip_country(hops, ranges)) == [("1.2.3.4", "AU"), ("9.9.9.9", "ZZ"), ("no", "ZZ")]
    har = json.dumps({"log": {"entries": [{"request": {"url": "http://a/"}, "response": {"status": 302, "redirectURL": "http://b/"}}, {"request": {"url": "http://b/"}, "response": {"status": 404, "redirectURL": ""}}]}})
    df = spark.createDataFrame([(har, "http://a/"), ("{", "http://x/")], "log string, url string")
    assert rows(df.select(traces.har_final(F.col("log"), F.col("url")).alias("f")).select("f.*")) == [("http://b/", 404), ("http://x/", None)]


# Streams


TWEETS = [
    {"id": 1, "user": {"id": 7, "screen_name": "x"}, "entities": {"urls": [{"expanded_url": "http://a/"}, {"url": "http://t/"}], "hashtags": [{"text": "B"}, {"text": "a"}]}, "withheld_copyright": True, "withheld_in_countries": ["FR"], "lang": "en", "created_at": "x"},
    {"id": 2, "user": {"id": 8}, "entities": {"urls": []}}, {"delete": {"id": 3}}, {"id": 4, "user": {"id": 9}},
]


def test_firehose_resumes_without_repeats(spark, tmp_path):
    src, dest, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    put(src / "1.json", "\n".join(map(json.dumps, TWEETS)))
    stream = lambda: incremental.firehose(spark, str(src))
    incremental.ingest(stream(), incremental.append_new(dest, ["id", "url"]), mark).awaitTermination(120)
    first = rows(spark.read.parquet(dest).select("id", "url", "hashtags", "withheld"))
    assert first == [(1, "http://a/", "a|b", "FR|ZZ"), (1, "http://t/", "a|b", "FR|ZZ")]
    put(src / "2.json", "\n".join(map(json.dumps, [TWEETS[0], {**TWEETS[0], "id": 5}])))
    incremental.ingest(stream(), incremental.append_new(dest, ["id", "url"]), mark).awaitTermination(120)
    assert spark.read.parquet(dest).count() == 4


def test_watermarked_dedupe_and_windows(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e/a"))
    events.limit(100).write.parquet(str(tmp_path / "e/b"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e/*"))
    got = {}
    incremental.ingest(incremental.deduplicated(stream, ["event_id"], "ts", "400 days"), lambda b, i: got.setdefault(i, b.count()), str(tmp_path / "m1")).awaitTermination(120)
    assert sum(got.values()) == events.count()
    q = incremental.window_counts(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "m2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from w").first()[0] == events.count() + 100
    assert incremental.session_counts(stream, "ts", "user_id").isStreaming


def test_incremental_batches(spark, tmp_path):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, at int")
    b = spark.createDataFrame([(2, 20), (3, 30)], "k int, at int")
    dest = str(tmp_path / "r")
    assert incremental.replicate(a, ["k"], dest) == 2 and incremental.replicate(b, ["k"], dest) == 1 and incremental.replicate(b, ["k"], dest) == 0
    assert rows(incremental.since_high_water(b, "at", a)) == [(3, 30)] and incremental.since_high_water(b, "at", None).count() == 2 and incremental.since_high_water(b, "at", a.limit(0)).count() == 2
    hist = spark.createDataFrame([("u", i) for i in range(1, 8)] + [("v", 1)], "k string, at int")
    assert [r.cycle for r in incremental.page_order(hist, "k", "at").orderBy("k", "at").collect()] == [2, 1, 2, 0, 2, 1, 2, 0]


def test_blobs_that_cannot_be_inflated(spark):
    from skein.functions.text import unzip

    df = spark.createDataFrame([(zlib.compress(b"x"),), (b"bad",), (None,)], "b binary")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in df.select(unzip(F.col("b"))).collect()] == [b"x", b"", None]
