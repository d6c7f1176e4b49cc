"""The standard views, as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def _as(df: DataFrame, key: str, to: str, **cols: str) -> DataFrame:
    return df.select(F.col(key).alias(to), *[F.col(c).alias(a) for a, c in cols.items()])


def extracted_content(t: Tables) -> DataFrame:
    """All parts of extracted pages: inner joins, the same table twice for pruned and full text and for links and resources."""
    text, urls = t["extracted_plaintext"], t["extracted_urls"]
    out = t["extracted_content_ov"].select("id", "content_len", "title", *[F.col(c).alias(f"{c}_id") for c in ("headings", "links", "resources", "dom_stats", "pruned", "fulltext")])
    out = out.join(_as(text, "id", "pruned_id", pruned="plaintext", lang="lang", segmented="segmented"), "pruned_id").join(_as(text, "id", "fulltext_id", fulltext="plaintext"), "fulltext_id")
    out = out.join(_as(urls, "id", "links_id", links="urls"), "links_id").join(_as(urls, "id", "resources_id", resources="urls"), "resources_id")
    out = out.join(_as(t["extracted_headings"], "id", "headings_id", headings="headings"), "headings_id").join(_as(t["extracted_dom_stats"], "id", "dom_stats_id", dom_stats="dom_stats"), "dom_stats_id")
    return out.drop("headings_id", "links_id", "resources_id", "dom_stats_id", "fulltext_id")


def capture_result(t: Tables) -> DataFrame:
    coarse = _as(t["capture_coarse_result"], "id", "result", coarse="result")
    return t["capture_fine_result"].join(coarse, "result").select("id", F.col("coarse").alias("result"), "detail")


def page_text(t: Tables) -> DataFrame:
    return t["extracted_plaintext"].join(_as(t["extracted_content_ov"], "pruned", "id", origin="id", title="title"), "id")


def page_observations(t: Tables) -> DataFrame:
    """Captures with their URLs, results and contents: six left joins; the URL table twice."""
    p = t["captured_pages"]
    out = p.join(_as(t["url_strings"], "id", "url", orig_url="url"), "url", "left").join(_as(t["url_strings"], "id", "redir_url", to_url="url"), "redir_url", "left")
    out = out.join(_as(capture_result(t), "id", "result", outcome="result", detail="detail"), "result", "left")
    out = out.join(_as(t["capture_html_content"], "id", "html_content", extracted="extracted", is_parked="is_parked"), "html_content", "left")
    out = out.join(_as(t["extracted_content_ov"], "id", "extracted", title="title", pruned="pruned"), "extracted", "left")
    out = out.join(_as(t["extracted_plaintext"], "id", "pruned", lang="lang"), "pruned", "left")
    return out.select(F.col("orig_url").alias("url"), F.col("to_url").alias("redir_url"), "country", "vantage", "access_time", F.col("outcome").alias("result"), "detail", "html_content", "extracted", "is_parked", "title", F.col("pruned").alias("text_id"), "lang")


def extraction_queue(t: Tables, lo: str, hi: str) -> DataFrame:
    """Contents seen in a closed range of time that were not extracted, with one URL each."""
    seen = t["captured_pages"].filter(F.col("access_time").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))).groupBy("html_content").agg(F.min("url").alias("url"))
    todo = t["capture_html_content"].filter("extracted is null").select(F.col("id").alias("html_content"), "content")
    return seen.join(todo, "html_content").join(_as(t["url_strings"], "id", "url", base="url"), "url").select("html_content", F.col("base").alias("url"), "content")


def crawl_queue(t: Tables) -> DataFrame:
    """The same over crawl pages: no range, every URL of a content."""
    todo = t["capture_html_content"].filter("extracted is null").select(F.col("id").alias("html_content"), "content")
    return t["common_crawl_pages"].select("url", "html_content").join(todo, "html_content").join(_as(t["url_strings"], "id", "url", base="url"), "url").select("html_content", F.col("base").alias("url"), "content")


def history_stream(t: Tables, archive: str, country: str, vantage: str = "") -> DataFrame:
    """Archived and present observations of URLs that have snapshots, in one frame (url, ts, result, is_parked)."""
    have = t["historical_page_availability"].filter((F.col("archive") == archive) & (F.size("snapshots") > 0)).select("url")
    old = t["historical_pages"].filter(F.col("archive") == archive).select("url", F.col("archive_time").alias("ts"), "result", "is_parked")
    now = t["captured_pages"].filter((F.col("country") == country) & (F.col("vantage") == vantage)).join(_as(t["capture_html_content"], "id", "html_content", is_parked="is_parked"), "html_content", "left").select("url", F.col("access_time").alias("ts"), "result", "is_parked")
    names = _as(capture_result(t), "id", "result", outcome="result")
    return old.unionByName(now).join(have, "url", "left_semi").join(names, "result", "left").select("url", "ts", F.col("outcome").alias("result"), "is_parked")
