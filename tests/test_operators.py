"""Relational, history, sampling, graph and ML operators, and the page store, on small rows."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skein import schema
from skein.operators import corpus, graph, history, ml, relational, sampling, sinks
from skein.plans import views
from skein.plans.store import PageStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Relational


def test_intern_keeps_ids_and_goes_on(spark):
    old = spark.createDataFrame([("b", 7), ("d", 9)], "k string, id int")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "k string")
    assert rows(relational.intern(new, "k", existing=old)) == [("a", 10), ("b", 7), ("c", 11), ("d", 9)]


def test_row_numbers_are_global(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    assert all(r.v + 1 == r.n for r in relational.row_numbers(df, ["v"]).collect())


def test_row_numbers_are_global_where_ranges_come_from_a_sample(spark):
    """Each plan draws its own sample; with columns that only some plans need, the plans differ."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small ranges become one
    try:
        df = spark.range(30000).select(F.hex(F.xxhash64("id")).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("g"), F.col("id").alias("more"))
        out = relational.row_numbers(df, ["g", "k"]).collect()
        firsts = {r.g: r.first for r in relational.row_numbers(df, ["g", "k"]).groupBy("g").agg(F.min("n").alias("first")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out.sort(key=lambda r: (r.g is not None, r.g or 0, r.k))
    assert [r.n for r in out] == list(range(1, 30001))
    assert all(firsts[r.g] <= r.n for r in out) and {out[firsts[g] - 1].g for g in firsts} == set(firsts)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, x double")
    new = spark.createDataFrame([(2, "B", 2.0), (3, None, 3.0)], "k int, s string, x double")
    assert rows(relational.upsert(old, new, ["k"])) == [(1, "a", 1.0), (2, "B", 2.0), (3, None, 3.0)]
    assert rows(relational.insert_new(old, new, ["k"])) == [(1, "a", 1.0), (2, "b", None), (3, None, 3.0)]
    assert rows(relational.seed_missing(old, new, ["k"])) == [(1, "a", 1.0), (2, "b", None), (3, None, None)]
    with pytest.raises(PySparkException):
        relational.strict_update(old, new, ["k"]).collect()
    assert rows(relational.strict_update(old, new.filter("k = 2"), ["k"])) == [(1, "a", 1.0), (2, "B", 2.0)]
    assert rows(relational.delta(new, old, ["k"])) == [(3, None, 3.0)]
    src = spark.createDataFrame([(2, "z")], "k int, t string")
    assert rows(relational.update_from(old, src, ["k"], {"s": "t"})) == [(1, "a", 1.0), (2, "z", None)]


def test_joins(spark):
    pts = spark.createDataFrame([(i,) for i in range(0, 100, 7)], "p long")
    ranges = spark.createDataFrame([(0, 10, "a"), (5, 70, "b"), (98, 99, "c")], "lo long, hi long, n string")
    want = sorted(((p, lo, hi, n) for p in range(0, 100, 7) for lo, hi, n in [(0, 10, "a"), (5, 70, "b"), (98, 99, "c")] if lo <= p < hi), key=repr)
    assert rows(relational.range_join(pts, ranges, "p", "lo", "hi", 8)) == want
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 8, 80)], "k string, t int, v int")
    assert rows(relational.asof(left, right, ["k"], "t", "v")) == [("k", 1, None), ("k", 5, 50), ("z", 9, None)]
    codes = spark.createDataFrame([("en", "eng"), ("fr", None)], "lc2 string, lc3 string")
    langs = spark.createDataFrame([("eng",), ("en",), ("fr",), ("xx",)], "l string")
    assert rows(relational.or_join(langs, codes, "l", ["lc2", "lc3"])) == [("en", "en", "eng"), ("eng", "en", "eng"), ("fr", "fr", None), ("xx", None, None)]
    assert rows(relational.distinct_on(right, ["k"], [-F.col("t")])) == [("k", 8, 80)] == rows(relational.latest_on(right, ["k"], ["t"]))
    good, bad = relational.isolate(right, F.col("v") > 20)
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(ValueError):
        relational.assert_empty(right, "not empty")
    urls = spark.createDataFrame([(1, "http://A/"), (2, "http://a/"), (3, "http://B/")], "id int, url string")
    assert rows(relational.bad_to_good(urls, F.lower("url"))) == [(1, 2, "http://A/", "http://a/"), (3, None, "http://B/", "http://b/")]
    assert rows(relational.renumber_first_seen([urls.filter("id = 3"), urls], "url")) == [("http://A/", 2), ("http://B/", 1), ("http://a/", 3)]
    assert rows(relational.inconsistent(spark.createDataFrame([("f", "x"), ("f", "y"), ("g", "x")], "fine string, c string"), "fine", "c")) == [("f", 2)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, t timestamp_ntz, v int")
    assert relational.zero_filled_days(none, "t").collect() == [] and relational.distinct_on(none, ["k"], ["v"]).collect() == [] and relational.row_numbers(none, ["k"]).collect() == []
    assert history.area_bins(none.select(F.col("k").alias("what"), F.col("v").alias("seconds"))).collect() == []


# Corpus


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "en", "a a b"), (2, "en", "a c"), (3, "fr", "")], "doc_id int, lang string, text string")
    tf = corpus.term_counts(corpus.tokens(docs))
    out = {(r.doc_id, r.word): r for r in corpus.tfidf(tf).collect()}
    from math import log

    assert out[1, "a"].tfidf == 0 and out[1, "b"].tfidf == pytest.approx(log(2)) and out[1, "b"].nfidf == pytest.approx(0.75 * log(2)) and out[2, "c"].nfidf == pytest.approx(log(2))
    assert rows(corpus.docs_per_group(tf)) == [("en", 2)]


# History


def stamps(days):
    return [datetime(2010, 1, 1) + timedelta(days=d) for d in days]


def thinned(days, lo, hi):
    """The rule in words: start, then 30 days apart while before hi, then the newest before hi."""
    days = sorted(days)
    lo, hi = min(lo, hi), max(lo, hi)
    if not days:
        return []
    before = [d for d in days if d <= lo]
    out = [before[-1] if before else days[0]]
    mid = [d for d in days if out[0] < d < hi]
    for d in mid:
        if d - out[-1] >= 30:
            out.append(d)
    late = [d for d in days if d >= hi and d > out[0]]
    last = (mid[-1] if mid else out[0]) if late else days[-1]
    return out + [last] * (last > out[-1])


def test_thinning(spark):
    rng = random.Random(3)
    cases = [([], 10, 20), ([5], 10, 20), ([30, 60], 10, 20), ([1, 2], 10, 20), ([0, 30, 60, 90], 0, 90), (list(range(0, 200, 3)), 150, 20)]
    cases += [(sorted(rng.sample(range(400), rng.randint(0, 40))), rng.randint(0, 400), rng.randint(0, 400)) for _ in range(150)]
    df = spark.createDataFrame([(i, stamps(d), stamps([lo])[0], stamps([hi])[0]) for i, (d, lo, hi) in enumerate(cases)], "i int, a array<timestamp_ntz>, lo timestamp_ntz, hi timestamp_ntz")
    got = {r.i: r.t for r in df.select("i", history.thin(F.col("a"), F.col("lo"), F.col("hi")).alias("t")).collect()}
    for i, (d, lo, hi) in enumerate(cases):
        assert got[i] == stamps(thinned(d, lo, hi)), cases[i]


def test_change_intervals(spark):
    t = stamps(range(10))
    data = [("a", t[0], "ok", False), ("a", t[1], "ok", False), ("a", t[3], "timeout", False), ("b", t[0], "ok", None), ("b", t[4], "ok", None), ("c", t[0], "timeout", False), ("c", t[1], "ok", False), ("d", t[0], "ok", True), ("e", t[0], "ok", None), ("e", t[2], "ok", True), ("z", t[5], "ok", False)]
    out = {r.url: (r.seconds, r.change) for r in history.change_intervals(spark.createDataFrame(data, "url string, ts timestamp_ntz, result string, is_parked boolean"), "url").collect()}
    assert out == {"a": (3 * 86400.0, "timeout"), "b": (4 * 86400.0, "unchanged"), "e": (2 * 86400.0, "parked"), "z": (0.0, "unchanged")}


def test_yearly_picks_runs_and_bins(spark):
    df = spark.createDataFrame([(stamps([0, 400, 800, 1000]), stamps([100])[0], stamps([1000])[0])], "a array<timestamp_ntz>, lo timestamp_ntz, hi timestamp_ntz")
    assert df.select(history.yearly_picks(F.col("a"), F.col("lo"), F.col("hi"))).first()[0] == stamps([800, 400, 0])
    assert spark.createDataFrame([(["a", "a", "b", "a"],)], "x array<string>").select(history.squeeze(F.col("x"))).first()[0] == ["a", "b", "a"]
    bins = history.area_bins(spark.createDataFrame([("x", 0.0), ("x", 86401.0), ("y", 86400.0)], "what string, seconds double"))
    assert rows(bins) == [(0, "original", 2), (0, "x", 1), (0, "y", 0), (1, "original", 1), (1, "x", 1), (1, "y", 1), (2, "original", 0), (2, "x", 2), (2, "y", 1)]
    assert history.topic_string([0, None, 61, 62]) == "0.Z^" and sorted(history.ruler_order(9)) == list(range(9)) and history.ruler_order(7)[:3] == [3, 1, 5]


def test_topics_ewma_and_pairs(spark):
    texts = [("u", 5, "en,cats dogs"), ("u", 4, "en,cats dogs birds"), ("u", 3, "en,tax law"), ("u", 2, "en,"), ("u", 1, "en,dogs cats")]
    out = history.topic_runs(spark.createDataFrame(texts, "k string, t int, x string"), "k", "t", "x")
    assert {r.t: r.topic for r in out.collect()} == {5: 0, 4: 0, 3: 1, 2: 2, 1: 0}
    e = history.ewma(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)], "k string, t int, v double"), "k", "t", "v")
    assert {r.k: r.ewma for r in e.collect()} == {"a": pytest.approx(1 + 2 / 11), "b": 5.0}
    ev = spark.createDataFrame([("k", 1, "start"), ("k", 2, "stop"), ("k", 3, "start"), ("k", 4, "start"), ("k", 5, "stop")], "k string, t int, w string")
    assert rows(history.session_pairs(ev, "k", "t", "w")) == [("k", 1, 2), ("k", 4, 5)]
    tr = history.transition_counts(ev.withColumn("t", F.timestamp_seconds("t")), "k", "t", "w")
    assert {(r["from"], r["to"]): r.n for r in tr.collect()} == {("start", "stop"): 2, ("stop", "start"): 1, ("start", "start"): 1}


# Samples


def test_samples(spark):
    df = spark.range(20_000).withColumn("w", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0))
    one = [r.id for r in sampling.random_ids(df, "id", 50, 1).collect()]
    assert one == [r.id for r in sampling.random_ids(df.repartition(7), "id", 50, 1).collect()] != [r.id for r in sampling.random_ids(df, "id", 50, 2).collect()]
    picked = sampling.weighted(df, "id", F.col("w"), 2000, 4)
    assert 0.70 < picked.filter("id % 2 = 0").count() / 2000 < 0.80 and picked.distinct().count() == 2000
    cap = sampling.capped(df.withColumn("g", F.col("id") % 7), "g", "id", 25, 100, 3)
    assert cap.count() == 100 and cap.groupBy("g").count().agg(F.max("count")).first()[0] <= 25
    ev = spark.range(3000).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 3 as int))").alias("ts"), (F.col("id") % 200).cast("string").alias("url"))
    assert sampling.stratified_by_day(ev, "ts", "url", 60, 1).count() <= 60
    w = spark.createDataFrame([(2, "http://x/a/b/"), (1, "http://x/")], "n int, u string").select(sampling.path_weight(F.col("n"), F.col("u"))).collect()
    assert [r[0] for r in w] == [pytest.approx(0.5 * 0.707**2), 1.0]


# Graph


def test_graph(spark):
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "a", "c"), ("t", "c", "d"), ("t", "b", "d"), ("s", "x", "y"), ("s", "y", "x")], "trace string, src string, dst string")
    out = graph.topo_sort(edges)
    assert [r.node for r in out.filter("trace = 't'").orderBy("pos").collect()] == ["a", "b", "c", "d"] and out.filter("trace = 's'").count() == 2
    assert sorted(tuple(r.path) for r in graph.paths(edges.filter("trace = 't'"), "a").collect()) == [("a", "b", "d"), ("a", "c", "d")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), min_size=1, max_size=12))
def test_levels_hold_every_node_once(edges):
    import pandas as pd

    flat = [n for lvl in graph.topo_levels(pd.DataFrame(edges, columns=["src", "dst"])) for n in lvl]
    assert sorted(flat) == sorted({n for e in edges for n in e})


# ML


def test_kmeans_finds_blobs(spark):
    rng = random.Random(1234)
    data = [(i, [rng.gauss(c * 10, 1.0), rng.gauss(-c * 10, 1.0)]) for i in range(600) for c in [i % 3]]
    df = ml.to_vectors(spark.createDataFrame(data + [(900, None), (901, [float("nan"), 1.0])], "id int, embedding array<double>"))
    out, centres, cost = ml.kmeans(df, 3, 20)
    assert len(centres) == 3 and cost > 0 and out.groupBy((F.col("id") % 3).alias("c")).agg(F.count_distinct("cluster").alias("n")).filter("n > 1").count() == 0
    assert [k for k, _ in ml.inertia(df, (2, 3))] == [2, 3] and len(ml.project(df).first()["pc"]) == 2 and ml.sparse_set(3, 4, "x") == ["0", "0", "0", "0", "x"]
    assert ml.normalized_kmeans(df, 2, 3)[0].count() == 600
    hot = ml.one_hot(spark.createDataFrame([("a",), ("b",), ("a",)], "s string"), "s")
    assert hot.count() == 3
    s = ml.counter_stats(spark.createDataFrame([(v,) for v in (1, 2, 2, 9)], "v int"), "v").first()
    assert (s["mean"], s["median"], s["median_low"], s["median_high"], s["mode"], s["max"]) == (3.5, 2.0, 2, 2, 2, 9)


# Store, views, constraints, sinks


@pytest.fixture(scope="module")
def tables(spark):
    t = {n: spark.createDataFrame([], s) for n, s in schema.TABLES.items()}
    make = lambda n, data: t.__setitem__(n, spark.createDataFrame(data, schema.TABLES[n]))
    at = datetime(2015, 1, 1)
    make("url_strings", [(1, "http://a/"), (2, "http://b/")])
    make("capture_coarse_result", [(1, "ok"), (2, "timeout")])
    make("capture_fine_result", [(10, 1, "200 OK"), (11, 2, "N4")])
    make("capture_html_content", [(5, b"h", b"c", 50, False, []), (6, b"i", b"d", None, None, None)])
    make("captured_pages", [(1, "us", "", at, 1.0, 10, 2, 5, 1), (1, "de", "x", at, 1.0, 11, None, None, 1), (2, "us", "", at, 1.0, 10, None, 6, 1)])
    make("extracted_plaintext", [(70, b"x", "pruned", "en", [("en", ["pruned"])]), (71, b"y", "full text", None, None)])
    make("extracted_urls", [(80, b"u", ["http://l/"]), (81, b"v", [])])
    make("extracted_headings", [(90, b"w", ["H"])])
    make("extracted_dom_stats", [(95, b"z", ({"p": 1}, {"0": 1}))])
    make("extracted_content_ov", [(50, 9, "T", 90, 80, 81, 95, 70, 71)])
    make("pruned_content_stats", [("tfidf", 70, [], {"pruned": 1.5})])
    make("corpus_stats", [("idf", "en", [], 3, {"pruned": 0.5})])
    return t


def test_views(tables):
    r = views.extracted_content(tables).collect()
    assert len(r) == 1 and (r[0].pruned, r[0].fulltext, r[0].links, r[0].headings) == ("pruned", "full text", ["http://l/"], ["H"])
    obs = {(r.url, r.country): r for r in views.page_observations(tables).collect()}
    assert len(obs) == 3 and obs["http://a/", "us"].lang == "en" and obs["http://a/", "us"].redir_url == "http://b/" and obs["http://a/", "de"].result == "timeout"
    assert [r.url for r in views.extraction_queue(tables, "2014-01-01", "2016-01-01").collect()] == ["http://b/"] and views.crawl_queue(tables).count() == 0
    assert views.history_stream(tables, "a", "us").count() == 0


def test_store(tables, spark):
    saved = {}
    store = PageStore(spark, tables.__getitem__, saved.__setitem__)
    assert store.locales == ["de", "us"]
    assert [tuple(r) for r in store.get_page_texts(load=["lang", "stat:tfidf"]).collect()] == [(70, "en", {"pruned": 1.5})]
    with pytest.raises(ValueError):
        store.get_page_texts(load=["nothing"])
    with pytest.raises(ValueError):
        store.get_page_observations(ordered="size")
    assert [r.country for r in store.get_page_observations("result = 'ok'", "country").collect()] == ["us", "us"] and store.get_page_observations(limit=1).count() == 1
    assert store.get_random_page_texts(1, 3).count() == 1 and store.get_random_page_observations(2, 3).count() == 2 and store.get_observations_for_text(70).count() == 1
    assert store.get_contents(70) == "pruned" and bytes(store.get_raw_contents(5)) == b"c" and store.get_headings(90) == ["H"] and store.get_links(80) == ["http://l/"] and store.get_dom_stats(95).tags == {"p": 1} and store.get_segmented(99) is None
    assert store.get_corpus_statistic("idf", "en") == (3, {"pruned": 0.5}) and store.get_corpus_statistic("idf", "xx") == (0, {}) and store.get_text_statistic("tfidf", 70) == {"pruned": 1.5} and store.get_text_statistic("x", 1) == {}
    with store:
        store.update_corpus_statistics(spark.createDataFrame([("idf", "en", 4, {"a": 1.0})], "stat string, lang string, n_documents bigint, data map<string,double>"))
        ready = store.prepare_text_statistic("nf")
        store.update_text_statistic(spark.createDataFrame([("nf", 70, {"a": 2.0})], "stat string, text_id bigint, data map<string,double>"), ready)
    assert saved["corpus_stats"].first()["n_documents"] == 4 and saved["pruned_content_stats"].count() == 3
    with pytest.raises(RuntimeError), store:
        store.update_corpus_statistics(spark.createDataFrame([], "stat string, lang string, n_documents bigint, data map<string,double>"))
        raise RuntimeError
    assert saved["corpus_stats"].count() == 1


def test_constraints(tables, spark):
    assert all(not v.collect() for v in schema.violations("captured_pages", tables) + schema.violations("corpus_stats", tables))
    bad = dict(tables, url_strings=spark.createDataFrame([(1, "x"), (2, "x"), (3, "")], schema.TABLES["url_strings"]))
    assert [v.count() for v in schema.violations("url_strings", bad)] == [1, 1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("en", "a", 1), ("en", "b", None), ("fr", "c", 0)], "lang string, w string, ok int")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    sinks.write_split(df, F.col("ok") == 1, str(tmp_path / "split"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "split")).select("w", "lang", F.col("accepted").cast("string"))) == [("a", "en", "true"), ("b", "en", "false"), ("c", "fr", "false")]
    assert sinks.latex_matrix([("a", "a", 3), ("a", "b", 1), ("b", "b", 2)], ["a", "b"]).splitlines()[2:4] == [r"a & 3 & 1 \\", r"b &  & 2 \\"]
    urls = spark.createDataFrame([("http://x/b",), ("http://x/a",), ("http://x/a",)], "url string")
    assert rows(sinks.site_blocks(urls)) == [("http://x", ["http://x/a", "http://x/b"])]
    sets = corpus.observation_sets(spark.createDataFrame([("h", "u", "us")], "hash string, url string, cc string"), "hash", "url", ["url", "cc"])
    assert rows(sinks.report_by_hash(sets, "hash")) == [(1, "h\n  u us")]


def test_bisection_ends_at_the_change_points(spark):
    from skein.operators import history

    values = {"u": [1, 1, 1, 2, 2, 2, 2, 1, 1, 3], "v": [5] * 6, "w": [1, 2]}
    every = spark.createDataFrame([(k, i, x) for k, xs in values.items() for i, x in enumerate(xs)], "url string, ts int, v int")
    asked = {("u", 0), ("u", 5), ("u", 9), ("v", 0), ("v", 5), ("w", 0), ("w", 1)}
    for _ in range(10):
        known = spark.createDataFrame([(k, i, values[k][i]) for k, i in asked], "url string, ts int, v int")
        more = {(r.url, r.ts) for r in history.bisect_changes(known, every, "url", "ts", "v").collect()}
        assert not more & asked
        if not more:
            break
        asked |= more
    assert not more and {("u", 2), ("u", 3), ("u", 6), ("u", 7), ("u", 8), ("u", 9)} <= asked and len([a for a in asked if a[0] == "v"]) == 2


def test_any_of_defaults_and_derived_joins(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, None)], "k int, s string, n int")
    assert rows(df.filter(relational.any_of([{"k": 1, "s": "a"}, {"s": None}])).select("k")) == [(1,), (3,)] and df.filter(relational.any_of([])).count() == 0 and df.filter(relational.any_of([{}])).count() == 3
    assert rows(relational.default_from(df, "n", spark.createDataFrame([(7,)], "v int"), "v").select("n")) == [(5,), (7,), (7,)]
    with pytest.raises(Exception, match="more than one row"):
        relational.default_from(df, "n", spark.createDataFrame([(7,), (8,)], "v int"), "v").collect()
    out = relational.derived_join(df.select("k", "n"), df.select("k", F.lit(5).alias("m")), ["k"], F.coalesce("n", F.lit(0)), F.col("m"))
    assert rows(out.select("k", "m")) == [(2, 5)]


def test_stderr_parking_files_and_page_targets(spark):
    from skein.functions import parked, status, text, url

    said = [None, "isolate: phantomjs: CPU time limit exceeded", "bad_alloc\nisolate: phantomjs: Aborted", "isolate: phantomjs: Segmentation fault\nodd", "isolate: phantomjs: Aborted", "odd"]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").withColumn("r", status.stderr_result(F.col("t"))).orderBy("i").select("r.*").collect()
    assert [(r.status, r.detail, r.log) for r in out] == [
        ("crawler failure", "unexplained unsuccessful exit", []), ("timeout", "CPU time limit exceeded", []), ("crawler failure", "out of memory", []), ("crawler failure", "out of memory", ["odd"]),
        ("crawler failure", "Aborted", []), ("crawler failure", "unexplained unsuccessful exit", ["odd"]),
    ]
    own = parked.read_rules("# c\n[strong]\na_x = href\\s*=\\s*x\n[weak1]\nw = foo\n[weak2]\nv = bar\n")
    assert [(k, t) for k, t, _ in own] == [("strong", "a_x"), ("weak1", "w"), ("weak2", "v")] and parked.verdict("<a HREF = x>", own) == (True, ["a_x"])
    modes = parked.read_modes("[min]\nw\nv\n")
    assert modes == {"min": ["w", "v"]} and parked.verdict("<a href=x> foo bar", parked.in_mode(own, modes["min"])) == (True, ["v", "w"])
    pages = spark.createDataFrame([("sedoparking.com",), ("x",), (None,)], "html string")
    assert rows(parked.parked_count(pages)) == [(3, 1)]
    assert url.page_targets("http://a/b/", "<META http-equiv='Refresh' content='0; URL=c?x=1&amp;y'><link href=/d rel='x canonical'>") == ("http://a/b/c?x=1&y", "http://a/d")
    assert url.page_targets("http://a/", "<meta http-equiv=refresh content=5>") == (None, None)
    assert rows(spark.createDataFrame([("zh-Hant",), ("en",)], "l string").select(text.language_alias(F.col("l"), back=True))) == [("en",), ("zh-TW",)]
