"""URL, HTML, text, parked, status and time functions."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import html, parked, status, text, timefmt, url


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize(
    "raw, strict, lenient",
    [
        ("HTTP://Example.COM", "http://example.com/", "http://example.com/"),
        ("http://example.com:80/a", "http://example.com/a", "http://example.com/a"),
        ("https://example.com:443", "https://example.com/", "https://example.com/"),
        ("https://example.com:80/", "https://example.com:80/", "https://example.com:80/"),
        ("http://@example.com:/x", "http://example.com/x", "http://example.com/x"),
        ("http://u:p@example.com/", "http://u:p@example.com/", "http://u:p@example.com/"),
        ("http://u@example.com/", "http://u@example.com/", "http://u@example.com/"),
        ("http://example.com/a b%zz%41%u1234?q=é#f g", "http://example.com/a%20b%25zz%41%u1234?q=%C3%A9#f%20g", "http://example.com/a%20b%25zz%41%u1234?q=%C3%A9#f%20g"),
        ("http:///example.com/x", "http://example.com/x", "http://example.com/x"),
        ("http:////example.com/x", "http://example.com/x", "http://example.com/x"),
        ("http://bücher.example/", "http://xn--bcher-kva.example/", "http://xn--bcher-kva.example/"),
        ("http://foo..com/", None, "http://foo..com/"),
        ("ftp://example.com/a", None, "ftp://example.com/a"),
        ("mailto:a@b", None, "mailto:a@b"),
        ("http://", None, "http:"),
        ("http://example.com:99999/", None, None),
    ],
)
def test_canonical_urls(raw, strict, lenient):
    assert url.canon_url(raw) == strict
    if lenient and lenient != "http:":
        assert url.canon_url(raw, lenient=True) == lenient


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[a-z0-9.\-]{1,20}(:[0-9]{1,4})?(/[ -~é]{0,20})?(\?[ -~]{0,10})?", fullmatch=True))
def test_canonical_is_idempotent(u):
    once = url.canon_url(u)
    if once is not None:
        assert url.canon_url(once) == once


def test_canonical_columns(spark):
    df = col(spark, ["http://A/", None, "x:y"])
    assert [r[0] for r in df.select(url.canonical(F.col("v"))).collect()] == ["http://a/", None, None]
    reasons = [tuple(r[0]) for r in df.select(url.canonical_with_reason(F.col("v"))).collect()]
    assert reasons[0] == ("http://a/", None) and reasons[1] == (None, None) and reasons[2][0] is None and reasons[2][1]


def test_site_urls():
    assert url.site_urls("example.com") == ["http://www.example.com/", "https://www.example.com/", "http://example.com/", "https://example.com/"]
    assert len(url.site_urls("example.com/a")) == 8 and "https://www.example.com/a" in url.site_urls("example.com/a")
    assert url.site_urls("www.example.com", http_only=True) == ["http://www.example.com/"]
    assert url.site_urls("192.0.2.1") == ["http://192.0.2.1/", "https://192.0.2.1/"]
    assert url.site_urls("example.com", www_only=True) == ["http://www.example.com/", "https://www.example.com/"]


@pytest.mark.parametrize(
    "base, ref, want",
    [
        ("http://a/b/c/d;p?q", "g", "http://a/b/c/g"), ("http://a/b/c/d;p?q", "./g", "http://a/b/c/g"), ("http://a/b/c/d;p?q", "g/", "http://a/b/c/g/"), ("http://a/b/c/d;p?q", "/g", "http://a/g"),
        ("http://a/b/c/d;p?q", "//g", "http://g/"), ("http://a/b/c/d;p?q", "?y", "http://a/b/c/d;p?y"), ("http://a/b/c/d;p?q", "#s", "http://a/b/c/d;p?q#s"), ("http://a/b/c/d;p?q", "..", "http://a/b/"),
        ("http://a/b/c/d;p?q", "../g", "http://a/b/g"), ("http://a/b/c/d;p?q", "../../g", "http://a/g"), ("http://a/b/c/d;p?q", "../../../g", "http://a/../g"), ("http://a/b/c/d;p?q", "mailto:x@y", "mailto:x@y"),
        ("http://a/b/c/d;p?q", "", "http://a/b/c/d;p?q"), ("", "x/y", "x/y"), ("http://a", "b", "http://a/b"), ("http://a/b", "host:80", "http://a/host:80"),
    ],
)
def test_urljoin(base, ref, want):
    assert url.urljoin(base, ref) == want


def test_outbound_links():
    assert url.outbound("http://a/p#x", ["#y", "q", "http://b/", "q", "p"]) == ["http://a/q", "http://b/"]


def test_url_classes(spark):
    cases = {
        "ftp://x/a": "non-http", "http://bit.ly/abc": "short", "http://notbit.ly.example/abc": "noext", "http://x/": "noext", "http://x/a/b?c=d.e": "noext", "http://x/a.html": "html", "http://x/a.PHP?x": "html", "http://x/read.txt": "text",
        "http://x/a.pdf#p": "doc", "http://x/a.jpg": "data", "http://x/a.zip": "data", "http://x/a.unheardof": "unknown",
    }
    out = col(spark, list(cases)).select("v", url.url_class(F.col("v"))).collect()
    assert {r[0]: r[1] for r in out} == cases


def test_domains(spark):
    df = col(spark, ["http://a.b.co.uk:80/x", "https://1.2.3.4/", "http://h.example.\\x", "http://256.1.1.1/"])
    assert [tuple(r) for r in df.select(url.domain(F.col("v")), url.is_ip(url.domain(F.col("v")))).collect()] == [("a.b.co.uk", False), ("1.2.3.4", True), ("h.example", False), ("256.1.1.1", False)]
    rules = url.read_suffixes(["// c", "com", "uk", "co.uk", "*.ck", "!www.ck", "// ===END ICANN DOMAINS===", "blogspot.com"])
    reg = lambda h: url.registered_domain(h, rules)
    assert [reg(h) for h in ("a.b.example.com", "x.co.uk", "co.uk", "a.b.c.ck", "www.ck", "x.www.ck", "a.blogspot.com", "com", "")] == ["example.com", "x.co.uk", None, "b.c.ck", "www.ck", "www.ck", "blogspot.com", None, None]
    pairs = spark.createDataFrame([("http://a.example.com/", "http://b.example.com/"), ("http://a.com/", "http://b.com/"), ("http://a.com/", None), ("http://1.2.3.4/", "http://b.com/")], "a string, b string")
    assert [r[0] for r in pairs.select(url.crosses_domain(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0]


@pytest.mark.parametrize("word, want", [("http://x.org/a", "http://x.org/a"), ("example.com", "example.com"), ("example.com/a(b)c,", "example.com/a(b)c"), ("foo", None), ("see http://x.org", None), ("a@b.com", None), ("foo.na@example.com", None)])
def test_url_at_the_start_of_text(word, want):
    assert url.url_at_start(word) == want


def test_archive_robots_chain_and_har(spark):
    assert url.archive_target("/web/2010/http://x/")[0] == "archived" and url.archive_target("http://web.archive.org/web/1/x")[0] == "archived" and url.archive_target("http://x/")[0] == "live"
    urls = col(spark, ["http://a/x", "http://a/private/x", "http://b/private"]).withColumnRenamed("v", "url")
    robots = spark.createDataFrame([("http://a/robots.txt", "User-agent: *\nDisallow: /private\nCrawl-delay: 3")], "site string, body string")
    assert sorted((r.url, r.crawl_delay) for r in url.allowed(urls, robots).collect()) == [("http://a/x", 3.0), ("http://b/private", 1.0)]
    har = [{"request": {"url": "http://a/"}, "response": {"status": 301, "redirectURL": "/b"}}, {"request": {"url": "http://a/b"}, "response": {"status": 200, "redirectURL": ""}}]
    assert url.final_status(har, "http://a/") == ("http://a/b", 200)
    loop = [{"request": {"url": "http://a/"}, "response": {"status": 302, "redirectURL": "http://a/"}}]
    assert url.final_status(loop, "http://a/") == ("http://a/", 302)
    df = spark.createDataFrame([("http://a", ["http://a/", "http://b/"])], "u string, c array<string>")
    assert df.select(url.in_chain(F.col("u"), F.col("c"))).first()[0]
    assert url.dns_name("Bücher.Example.") == "xn--bcher-kva.example" and url.dns_name("a..b") is None and url.dns_name("-a.b") is None


def test_precanonical_and_postcanonical(spark):
    df = col(spark, ["example.com", "http://x/a/b///", "http://x/#f", "https://x"])
    out = [(r[0], r[1], r[2]) for r in df.select(url.precanonical(F.col("v")), url.postcanonical(F.col("v")), url.is_siteroot(F.col("v"))).collect()]
    assert out == [("http://example.com/", "example.com", False), ("http://x/a/b///", "http://x/a/b", False), ("http://x/#f", "http://x/", False), ("https://x/", "https://x", True)]


# HTML


PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><base href="/base/"><link rel="stylesheet" href="s.css"><link rel="next" href="n"><script src=x.js>var a = "<p>";</script></head>
<body><nav><a href="one">1</a></nav><h1>Head <b>line</b></h1><p>First<p>Second <a href="#top">top</a><img src=i.png srcset=" j.png 2x, k.png"><form action="go"><input src=b.png formaction="there"></form>
<ul><li>x<li>y</ul><iframe src="f.html">no</iframe><table><tr><td>1<td>2<tr><td>3</table></body></html>"""


def test_extract_a_page():
    x = html.extract("http://h/d/p", PAGE)
    assert x["url"] == "http://h/base/" and x["title"] == "A & B" and x["headings"] == ["Head line"]
    assert x["text_content"] == "1 Head line First Second top x y 1 2 3"
    assert x["links"] == ["http://h/base/n", "http://h/base/one", "http://h/base/there"]
    assert x["resources"] == [f"http://h/base/{n}" for n in ("b.png", "f.html", "go", "i.png", "j.png", "k.png", "s.css", "x.js")]
    tags, depths = x["dom_stats"]["tags"], x["dom_stats"]["tags_at_depth"]
    assert (tags["p"], tags["li"], tags["td"], tags["tr"], tags["a"]) == (2, 2, 3, 2, 2) and depths["0"] == 1 and depths["1"] == 2 and sum(tags.values()) == sum(depths.values())
    assert x["threshold"] <= max(1e9, x["threshold"]) and x["text_pruned"]


def test_pruning_keeps_the_dense_part():
    nav = "".join(f'<li><a href="/very/long/link/number/{i}">m{i}</a></li>' for i in range(30))
    body = "".join(f"<p>{'Long running prose of the article. ' * 12}</p>" for _ in range(8))
    x = html.extract("http://h/", f"<html><body><nav><ul>{nav}</ul></nav><article>{body}</article><footer>f</footer></body></html>")
    assert "running prose" in x["text_pruned"] and "m17" not in x["text_pruned"]
    assert "m17" in x["text_content"]


@pytest.mark.parametrize("page", ["", None, "plain words", "<p>", "<b><i></b></i>", "</div></p>", "<a", "<!-- open", "<script>never closed", "<html><frameset><frame src=a></frameset></html>", "<div>" * 3000, "\x00<p>x"])
def test_odd_pages_do_not_break(page):
    x = html.extract("http://h/", page)
    assert isinstance(x["text_content"], str) and isinstance(x["threshold"], float)


def test_types_and_charsets():
    sniff = html.sniff_type
    assert [sniff("", "", b) for b in (b" \n<HTML>", b"<!DOCTYPE html>", b"<?xml v", b"%PDF-1", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"hello", b"\x00\x07", b"<bogus>")] == ["text/html", "text/html", "text/xml", "application/pdf", "image/gif", "image/png", "text/plain", "application/octet-stream", "text/plain"]
    assert sniff("text/plain", "utf-8", b"\x00") == "application/octet-stream" and sniff("text/html", "", b"\x00") == "text/html"
    assert html.extract("http://h/i", b"GIF89a", "", "")["resources"] == [] and html.extract("http://h/i", b"a < b", "text/plain", "")["text_content"] == "a < b"
    assert html.to_text(b"\xef\xbb\xbf\xc3\xa9") == "é" and html.to_text("é".encode("utf-16")) == "é" and html.to_text(b"\xe9") == "é"
    assert html.to_text(b'<meta charset="koi8-r">\xc1') == "<meta charset=\"koi8-r\">а"
    both = b'<meta http-equiv="content-type" content="text/html; charset=koi8-r"><meta charset=windows-1251>\xe0'
    assert html.to_text(both)[-1] == "а" and html.declared_charset(b"<!-- <meta charset=koi8-r> -->") is None and html.declared_charset(b"<meta charset=utf-16>") == "utf-8"


def test_extract_frames(spark, sf):
    df = html.extract_pages(spark.read.parquet(f"{sf}/pages.parquet"), keep=("page_id",))
    rows = df.select("page_id", "title", "headings", *html.dom_totals(F.col("dom_stats"))).collect()
    assert len(rows) == 50 and all(len(r.headings) == 1 and r.n_tags > 10 and r.max_depth >= 3 for r in rows)


def test_top_nodes():
    assert html.top_nodes("<body><div><p>a<p>b<p>c</div><div><p>d</div></body>", 1) == ["a b c"]


# Parked domains


def test_parked_rules():
    own = parked.rules()
    assert len([1 for k, _, _ in own if k == "strong"]) == 56 and len(own) == 61
    assert parked.verdict('<a href="http://x/index.php?keywords=y">', own) == (True, ["old_colorparking_noad"])
    assert parked.verdict("This domain is for sale", own) == (False, ["w_domainparking_noad"])
    assert parked.verdict("Related Searches", own) == (False, ["w_sponsoredresults_ad"])
    assert parked.verdict("buy this domain - sponsored listings", own) == (True, ["w_buydomain_noad", "w_sponsoredresults_ad"])
    assert parked.verdict("Bodis. All  Rights\nReserved.", parked.rules("min")) == (True, ["newest_bodis"])
    assert parked.verdict("i.nuseek.com", parked.rules("min")) == (False, []) and parked.verdict(None, own) == (False, [])
    assert parked.verdict("sedoparking.com", own, most=5) == (False, [])
    with pytest.raises(ValueError):
        parked.rules("other")


def test_parked_column(spark):
    out = col(spark, ["sedoparking.com", "x", None]).select(parked.is_parked(F.col("v"), "balanced").alias("p")).select("p.*").collect()
    assert [(r.is_parked, list(r.rules_matched)) for r in out] == [(True, ["old_sedoparking_ad"]), (False, []), (False, [])]


# Text


def test_segmentation():
    assert text.presegment("Hello, WORLD! it's e.g. (a-b) http://X.org/Y?z. Straße ﬁn ２") == ["hello", "world", "it's", "e.g", "a-b", "http://X.org/Y?z", "strasse", "fin", "2"]
    assert text.segment("zh", "我们 abc中文") == ["我", "们", "abc", "中", "文"]
    assert text.split_chinese("我们好", frozenset(["我们"])) == ["我们", "好"]
    assert text.segment("ar", "والكتاب") == ["و", "الكتاب"]
    text.register_splitter("xx", lambda w: list(w))
    assert text.segment("xx", "ab c") == ["a", "b", "c"]
    assert text.presegment(None) == text.presegment(" \n") == text.presegment("!!! --") == []


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_words_are_folded_and_trimmed(t):
    for w in text.presegment(t):
        if not re.match(r"(?i)https?:|[a-z0-9.\-]+\.", w):
            assert w == unicodedata.normalize("NFKC", w).casefold() or unicodedata.normalize("NFKC", w) != w
            assert w.strip()


@pytest.mark.parametrize("s, n", [("", 0), ("a", 1), ("\r\n", 1), ("é", 1), ("각", 1), ("각", 1), ("🇫🇷🇩🇪", 2), ("ab", 2)])
def test_graphemes(s, n):
    assert html.graphemes(s) == n


def test_text_columns(spark):
    df = col(spark, ["ab\x00c", None, " \tx  y\n", "123 !", "ﬁ"])
    c = F.col("v")
    out = df.select(text.without_nul(c).alias("nul"), text.split_ascii(c).alias("w"), text.is_nonword(c).alias("non"), text.normalized(c).alias("norm"), text.n_graphemes(c).alias("g"), text.chunks(c, 2).alias("ch")).collect()
    assert [r.nul for r in out][0] == "ab�c" and out[2].w == ["x", "y"] and [r.non for r in out] == [False, None, False, True, False]
    assert out[4].norm == "fi" and out[1].norm is None and out[3].g == 5 and out[0].ch == ["ab", "\x00c"]
    raw = spark.createDataFrame([(b"\xc3\xa9",), (b"\xe9",)], "b binary")
    assert [r[0] for r in raw.select(text.decode_lenient(F.col("b"))).collect()] == ["é", "é"]
    words = col(spark, ["...", "http://a", "www.x.org", "12,5", "word", "a.com/b"]).select(text.token_class(F.col("v"))).collect()
    assert [r[0] for r in words] == ["symbols", "urls", "urls", "numeric", "words", "urls"]


def test_triage_batches_and_diffs():
    assert text.triage(["word", "123", "x.com", "y" * 800]) == (["word"], ["123", "x.com", "y" * 800])
    got = text.batches(["abc"] * 300 + ["z" * 4_990] * 2)
    assert [len(b) for b in got][:2] == [128, 128] and all(sum(map(len, b)) <= 5_000 for b in got) and sum(map(len, got)) == 302
    assert text.diff_lines(["a", "b"], ["a", "c"]).splitlines()[-2:] == ["-b", "+c"] and text.diff_lines(["a"], ["a"]) == ""
    assert text.is_junk("12-3") and text.is_junk("a.b.com/x") and not text.is_junk("word")


def test_translation_and_detection(spark):
    words = spark.createDataFrame([(1, 0, "fr", "Chat"), (1, 1, "de", "Hund"), (1, 2, "fr", "xyz")], "doc_id int, pos int, lang string, word string")
    table = spark.createDataFrame([("fr", "Chat", " the  cat"), ("de", "Hund", "dog")], "lang string, word string, engl string")
    assert text.translate(words, table).collect()[0].text == "de fr,the cat dog xyz"
    assert text.language_scores("the cat and the dog are in the house of the king")[0][0] == "en"
    assert text.language_scores("Съешь ещё этих мягких")[0][0] == "ru" and text.language_scores("") == [("un", 0.0)]
    assert [a for a, _ in text.language_runs("the cat is in the house\nle chat est dans la maison et le jardin")] == ["en", "fr"]


def test_compression_sizes(spark):
    r = col(spark, ["ab" * 500, None]).select(text.compressed_sizes(F.col("v")).alias("c")).select("c.*").collect()
    assert r[0].raw == 1000 and r[0].z9 <= r[0].z < 50 and r[1].raw == 0


# Status and time


def test_categories(spark):
    df = spark.createDataFrame([("200", ""), ("N3", ""), ("N99", "N99 Host unreachable"), ("N99", "?"), ("N555", ""), ("timeout", ""), ("hostname not found", ""), ("what", ""), ("418", ""), ("526", "")], "s string, d string")
    out = [tuple(r) for r in df.select(status.category_a(F.col("s"), F.col("d")), status.category_b(F.col("s"))).collect()]
    assert [a for a, _ in out] == ["ok", "host not found", "server unreachable", "crawler failure", "crawler failure", "timeout", "host not found", "crawler failure", "other HTTP response", "proxy error (502/504/52x)"]
    b = col(spark, ["dns-notfound", "tls-invalid", "success", "404", "timeout"])
    assert [r[0] for r in b.select(status.category_b(F.col("v"))).collect()] == ["host not found", "TLS handshake failed", "crawler failure", "page not found (404/410)", "other network error"]
    assert b.select(status.category_b(F.col("v"), more=True)).collect()[-1][0] == "timeout"
    r = spark.createDataFrame([(451, "Legal"), (299, None)], "c int, r string").select(status.http_result(F.col("c"), F.col("r")).alias("x")).select("x.*").collect()
    assert [tuple(x) for x in r] == [("unavailable for legal reasons (451)", "451 Legal"), ("other HTTP response", "299")]
    groups = col(spark, ["Alexa 2014", "Herdict 2014", "Norway 2009 (Wikileaks)", "x"]).select(status.source_group(F.col("v"))).collect()
    assert [g[0] for g in groups] == ["control", "sensitive", "leak", None]


def test_times(spark):
    df = col(spark, ["3 days, 1:02:03.5", "0:00:01", "-1 days, 23:59:59", "bad", None])
    assert [r[0] for r in df.select(timefmt.interval_seconds(F.col("v"))).collect()] == [262923.5, 1.0, -1.0, None, None]
    one = col(spark, ["20100102030405", "x"]).select(timefmt.archive_stamp(F.col("v"))).collect()
    assert one[0][0].isoformat() == "2010-01-02T03:04:05" and one[1][0] is None
    assert col(spark, ["Wed Aug 27 13:08:45 +0000 2008"]).select(F.unix_seconds(timefmt.mail_date(F.col("v")))).first()[0] == 1219842525
    assert [r[0] for r in col(spark, [35, 36, 123456789], "long").select(timefmt.base36(F.col("v"))).collect()] == ["z", "10", "21i3v9"]
    assert col(spark, [3725.5], "double").select(timefmt.elapsed(F.col("v"))).first()[0] == "1:02:05.50"
    meta = spark.createDataFrame([('{"timestamp": "2014-05-06T01:02"}', "2001-01-01"), ('{"date": "2013-01-02"}', "2001-01-01"), ("{}", "2001-01-01")], "m string, l string")
    assert [str(r[0]) for r in meta.select(timefmt.meta_date(F.col("m"), F.col("l"))).collect()] == ["2014-05-06", "2013-01-02", "2001-01-01"]
