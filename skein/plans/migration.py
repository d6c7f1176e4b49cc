"""One-off jobs on whole sets of tables: merging runs into the common tables, copying a run's sources, statistics of a corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import corpus
from skein.operators.relational import intern, renumber_first_seen
from skein.plans.views import Tables

# Labels that older runs spelled in another way.
LABELS = {
    "Germany 2014 (BPjM hashbusting)": "Germany 2014 (#BPjMleak)", "India (2012; Assam riots)": "India 2012 (Assam riots)", "India (Anonymous, 2012)": "India 2012 (Anonymous)", "Italy (2009; Wikileaks)": "Italy 2009 (Wikileaks)",
    "Norway (2009; Wikileaks)": "Norway 2009 (Wikileaks)", "Russia (2014; rublacklist.net)": "Russia 2014 (rublacklist.net)", "Thailand (2007; Wikileaks)": "Thailand 2007 (Wikileaks)",
}


def label(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def country(locale: Column) -> Column:
    return F.substring(locale, 1, 2)


def vantage(locale: Column) -> Column:
    """What follows the country, empty without."""
    return F.regexp_extract(locale, r"^[a-z][a-z]_(.+)$", 1)


def _all(runs: Sequence[Tables], name: str, *cols: Column | str) -> DataFrame:
    return reduce(DataFrame.unionByName, [r[name].select(*cols) for r in runs])


def contents(runs: Sequence[Tables], column: str, known: DataFrame | None = None) -> DataFrame:
    """(id, hash, column) of the distinct blobs of all runs, the empty one among them."""
    spark = runs[0]["captured_pages"].sparkSession
    blobs = _all(runs, "captured_pages", column).unionByName(spark.createDataFrame([(b"",)], f"{column} binary")).filter(F.col(column).isNotNull())
    distinct = blobs.select(F.unhex(F.sha2(column, 256)).alias("hash"), column).groupBy("hash").agg(F.min(column).alias(column))
    return distinct.join(intern(distinct, "hash", existing=known), "hash").select("id", "hash", column)


def merge_runs(runs: Sequence[Tables]) -> Tables:
    """The common tables of several runs (url_strings, capture_detail, captured_pages): ids anew, results and blobs interned, one row for each capture."""
    urls = intern(_all(runs, "url_strings", "url"), "url")
    coarse_of = F.when(F.col("result") == "ok (redirected)", "ok").otherwise(F.col("result"))
    pairs = reduce(DataFrame.unionByName, [r["captured_pages"].select(coarse_of.alias("coarse"), F.col("detail").alias("d")).join(r["capture_detail"].select(F.col("id").alias("d"), "detail"), "d").select("coarse", "detail") for r in runs])
    # a detail that stands under several results keeps the first by name
    pairs = pairs.groupBy("detail").agg(F.min("coarse").alias("coarse"))
    coarse = intern(pairs, "coarse").select("id", F.col("coarse").alias("result"))
    fine = pairs.join(coarse.select(F.col("id").alias("result"), F.col("result").alias("coarse")), "coarse").join(intern(pairs, "detail"), "detail").select("id", "result", "detail")
    html, logs = contents(runs, "html_content"), contents(runs, "capture_log")

    def pages(r: Tables) -> DataFrame:
        ids = r["url_strings"].select(F.col("id").alias("rid"), "url").join(urls.select(F.col("id").alias("nid"), "url"), "url").select("rid", "nid")
        details = r["capture_detail"].select(F.col("id").alias("detail"), F.col("detail").alias("text")).join(fine.select(F.col("id").alias("result"), F.col("detail").alias("text")), "text").select("detail", "result")
        p = r["captured_pages"].drop("result").withColumns({"hh": F.unhex(F.sha2(F.coalesce("html_content", F.lit(b"")), 256)), "lh": F.unhex(F.sha2("capture_log", 256))}).drop("html_content", "capture_log")
        p = p.join(ids.select(F.col("rid").alias("url"), F.col("nid").alias("u")), "url", "left").join(ids.select(F.col("rid").alias("redir_url"), F.col("nid").alias("v")), "redir_url", "left").join(details, "detail", "left")
        p = p.join(html.select(F.col("id").alias("html_content"), F.col("hash").alias("hh")), "hh", "left").join(logs.select(F.col("id").alias("capture_log"), F.col("hash").alias("lh")), "lh", "left")
        return p.select(F.col("u").alias("url"), country(F.col("locale")).alias("country"), vantage(F.col("locale")).alias("vantage"), "access_time", "result", F.coalesce("v", "u").alias("redir_url"), "html_content", "capture_log")

    return {
        "url_strings": urls.select("id", "url"), "capture_coarse_result": coarse, "capture_fine_result": fine, "capture_html_content": html.withColumnRenamed("html_content", "content"),
        "capture_logs": logs.withColumnRenamed("capture_log", "log"), "captured_pages": reduce(DataFrame.unionByName, map(pages, runs)),
    }


def copy_sources(old: Tables, exclude: Sequence[str] = ()) -> Tables:
    """A new run's tables: ancillary ones as they are, URL tables with ids given anew by table and URL; captures stay behind."""
    skip = {"capture_detail", "captured_pages", *exclude}
    names = sorted(n for n in old if n not in skip and n != "url_strings")
    url_tables = [n for n in names if n.startswith("urls_")]
    strings = old["url_strings"].select(F.col("id").alias("url"), F.col("url").alias("string"))
    own = {n: old[n].join(strings, "url") for n in url_tables}
    ids = renumber_first_seen([own[n] for n in url_tables], "string", "id")
    out = {n: old[n] for n in names if n not in url_tables}
    for n in url_tables:
        out[n] = own[n].drop("url").join(ids.select(F.col("id").alias("url"), "string"), "string").select(*old[n].columns)
    return out | {"url_strings": ids.select("id", F.col("string").alias("url"))}


def corpus_statistics(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus_stats, pruned_content_stats) of texts (id, segmented): frequencies and IDF of languages, TF-IDF and its normal form of texts, as maps."""
    words = texts.select("id", F.explode("segmented").alias("s")).select("id", F.col("s.l").alias("lang"), F.explode("s.t").alias("word"))
    tf = corpus.term_counts(words, "id")
    n = corpus.docs_per_group(tf, "id")
    stats = corpus.word_freq(words).select("lang", "word", F.lit("cwf").alias("stat"), F.col("cwf").cast("double").alias("v"))
    idf = corpus.idf(tf, "id")
    stats = stats.unionByName(idf.select("lang", "word", F.lit("rdf").alias("stat"), F.col("rdf").cast("double").alias("v"))).unionByName(idf.select("lang", "word", F.lit("idf").alias("stat"), F.col("idf").alias("v")))
    as_map = F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("data")
    per_lang = stats.groupBy("stat", "lang").agg(as_map).join(n.withColumnRenamed("n_docs", "n_documents"), "lang").select("stat", "lang", F.array().cast("array<int>").alias("runs"), "n_documents", "data")
    scores = corpus.tfidf(tf, "id").groupBy("id", "word").agg(F.max("tfidf").alias("tfidf"), F.max("nfidf").alias("nfidf"))
    long = scores.select("id", "word", F.explode(F.array(F.struct(F.lit("tfidf").alias("stat"), F.col("tfidf").alias("v")), F.struct(F.lit("nfidf").alias("stat"), F.col("nfidf").alias("v")))).alias("e")).select("id", "word", "e.stat", "e.v")
    per_text = long.groupBy("stat", "id").agg(as_map).select("stat", F.col("id").alias("text_id"), F.array().cast("array<int>").alias("runs"), "data")
    return per_lang, per_text


def translation_todo(segmented: DataFrame, known: DataFrame) -> DataFrame:
    """Words of segmented texts (segmented) that have no translation yet, once each."""
    words = segmented.select(F.explode("segmented").alias("s")).select(F.col("s.l").alias("lang"), F.explode("s.t").alias("word")).distinct()
    return words.join(known, ["lang", "word"], "left_anti")


def todo_report(words: DataFrame) -> DataFrame:
    return words.agg(F.count_distinct("lang").alias("langs"), F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"))


def segment_changes(old: DataFrame, new: DataFrame, langs: Sequence[str] | None = None) -> DataFrame:
    """id, diff of texts (id, segmented) that two segmenters cut in different ways, for the languages of interest."""
    from skein.functions.text import diff_lines
    from skein.functions.url import pandas_map2

    both = old.select("id", F.col("segmented").alias("p")).join(new.select("id", F.col("segmented").alias("q")), "id").filter("p <> q")
    if langs:
        both = both.filter(F.exists("p", lambda s: s["l"].isin(*langs)))
    lines = lambda segs: [f"{s['l']}  {w}" for s in segs for w in s["t"]]
    diff = pandas_map2(lambda a, b: diff_lines(lines(a), lines(b)), "string")
    return both.select("id", diff("p", "q").alias("diff"))


def url_only_contents(pages: DataFrame, content: str = "html", most: int = 512) -> DataFrame:
    """Pages whose short content is nothing but a URL."""
    from skein.functions.url import pandas_map, url_at_start

    size = F.octet_length(content)
    return pages.filter((size > 0) & (size < most)).withColumn("inner_url", pandas_map(url_at_start, "string")(F.trim(content))).filter(F.col("inner_url") == F.trim(content))


def deep_pages(df: DataFrame, stats: str = "dom_stats", least: int = 95) -> DataFrame:
    """Pages whose DOM is at least so deep, without crawler failures."""
    depth = F.array_max(F.transform(F.map_keys(F.col(stats)["tags_at_depth"]), lambda k: k.cast("int")))
    return df.filter((F.col("result") != "crawler failure") & (depth >= least))


def feature_matrix(obs: DataFrame) -> DataFrame:
    """A row for each (locale, url): result code and detail, redirect flags, lengths and DOM totals; obs are captures with extracted parts."""
    from skein.functions.html import dom_totals
    from skein.functions.url import crosses_domain

    redirects = F.coalesce(F.col("redir_url") != F.col("url"), F.lit(False))
    return obs.select(
        "locale", "url", F.col("result").alias("code"), "detail", redirects.alias("isredir"), F.when(redirects, crosses_domain(F.col("url"), F.col("redir_url"))).otherwise(0).alias("redirdomain"),
        F.length("html").cast("long").alias("html_length"), F.length("text_pruned").cast("long").alias("content_length"), *dom_totals(F.col("dom_stats")),
    )


def changes_by_day(bins: DataFrame) -> DataFrame:
    """Sums of daily numbers by day and plotted kind of change; bins: day, what, n."""
    from skein.functions.status import plot_change

    return bins.groupBy("day", plot_change(F.col("what")).alias("what")).agg(F.sum("n").alias("n"))


def group_of_urls(urls: DataFrame) -> DataFrame:
    """The weightiest group of each URL's sources: leak, then sensitive, then control. urls: url, source."""
    from skein.functions.status import source_group

    weight = F.create_map(F.lit("leak"), F.lit(3), F.lit("sensitive"), F.lit(2), F.lit("control"), F.lit(1))
    g = source_group(F.col("source"))
    return urls.select("url", g.alias("group"), F.try_element_at(weight, g).alias("w")).filter("w is not null").groupBy("url").agg(F.max_by("group", "w").alias("group"))
