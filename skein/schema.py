"""Schemas of the core tables, declared up front, and checks of their constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<l:string,t:array<string>>>"
DOM_STATS = "struct<tags:map<string,bigint>,tags_at_depth:map<string,bigint>>"

TABLES: dict[str, str] = {
    "language_codes": "lc2 string, lc3 string, name string",
    "country_codes": "cc2 string, cc3 string, name string, rwb_score float, rwb_rank int, fh_score float",
    "clab_categories": "code string, description string",
    "url_strings": "id bigint, url string",
    "url_sources": "id int, name string, last_updated date, meta string",
    "urls": "url bigint, src int, meta string",
    "capture_coarse_result": "id int, result string",
    "capture_fine_result": "id int, result int, detail string",
    "capture_html_content": "id bigint, hash binary, content binary, extracted bigint, is_parked boolean, parking_rules_matched array<string>",
    "capture_logs": "id bigint, hash binary, log binary",
    "captured_pages": "url bigint, country string, vantage string, access_time timestamp_ntz, elapsed_time float, result int, redir_url bigint, html_content bigint, capture_log bigint",
    "historical_pages": "url bigint, archive string, archive_time timestamp_ntz, result int, redir_url bigint, html_content bigint, topic_tag int, is_parked boolean",
    "historical_page_availability": "archive string, url bigint, snapshots array<timestamp_ntz>, earliest_date timestamp_ntz, latest_date timestamp_ntz, processed boolean",
    "common_crawl_pages": "id bigint, url bigint, date timestamp_ntz, html_content bigint",
    "extracted_plaintext": "id bigint, hash binary, plaintext string, lang string, segmented " + SEGMENTS,
    "extracted_urls": "id bigint, hash binary, urls array<string>",
    "extracted_headings": "id bigint, hash binary, headings array<string>",
    "extracted_dom_stats": "id bigint, hash binary, dom_stats " + DOM_STATS,
    "extracted_content_ov": "id bigint, content_len bigint, title string, headings bigint, links bigint, resources bigint, dom_stats bigint, pruned bigint, fulltext bigint",
    "extracted_pt_resegment": "id bigint, segmented " + SEGMENTS,
    "pruned_content_stats": "stat string, text_id bigint, runs array<int>, data map<string,double>",
    "corpus_stats": "stat string, lang string, runs array<int>, n_documents bigint, data map<string,double>",
    "translations": "lang string, word string, engl string",
    "features": "locale string, url bigint, tfidf string, tfidf_url string, tfidf_locale string, code string, detail string, isredir boolean, redirdomain boolean, html_length bigint, content_length bigint, dom_total bigint, dom_types int, dom_depths int, dom_max_depth int",
    "urls_alexa": "url bigint, retrieval_date date, rank int",
    "urls_citizenlab": "url bigint, country string, category string",
    "urls_herdict": "url bigint, timestamp timestamp_ntz, accessible boolean, country string",
    "urls_pinboard": "url bigint, username string, access_time timestamp_ntz, title string, annotation string, tags string",
    "urls_staticlist": "url bigint, listid int",
    "static_list_metadata": "id int, label string, url string, date date",
    "urls_tweeted": "uid bigint, timestamp bigint, url bigint, retweets bigint, possibly_sensitive boolean, lang string, withheld string, hashtags string",
    "urls_twitter_user_profiles": "uid bigint, url bigint",
    "twitter_users": "uid bigint, created_at timestamp, verified boolean, protected boolean, screen_name string, full_name string, lang string, location string, description string",
}

#: (table, columns) that are unique, and conditions that hold.
UNIQUE = [("url_strings", ["url"]), ("captured_pages", ["url", "country", "vantage", "access_time"]), ("historical_pages", ["url", "archive", "archive_time"]), ("pruned_content_stats", ["stat", "text_id", "runs"]), ("corpus_stats", ["stat", "lang", "runs"])]
CHECKS = [("extracted_content_ov", "content_len >= 0"), ("corpus_stats", "n_documents >= 1"), ("url_strings", "url <> ''")]
REFERENCES = [("capture_fine_result", "result", "capture_coarse_result", "id"), ("captured_pages", "url", "url_strings", "id"), ("captured_pages", "html_content", "capture_html_content", "id"), ("historical_pages", "url", "url_strings", "id")]


def violations(name: str, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Rows of a table that break its constraints, one frame for each constraint."""
    df = tables[name]
    out = [df.groupBy(*cols).count().filter("count > 1") for t, cols in UNIQUE if t == name]
    out += [df.filter(~F.coalesce(F.expr(c), F.lit(True))) for t, c in CHECKS if t == name]
    out += [df.filter(F.col(c).isNotNull()).join(tables[r].select(F.col(k).alias(c)), c, "left_anti") for t, c, r, k in REFERENCES if t == name and r in tables]
    return out
