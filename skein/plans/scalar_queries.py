"""Queries on scalar, array, map and JSON functions, and on small jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import status, text, timefmt, url
from skein.operators import history, relational
from skein.plans import migration
from skein.plans.registry import query, table

_LOCALES = "['us', 'de_home', 'fr_lab_2', 'xx']"


@query(f"SELECT event_id, substr(l, 1, 2) AS country, regexp_extract(l, '^[a-z][a-z]_(.+)$', 1) AS vantage FROM (SELECT event_id, {_LOCALES}[event_id % 4 + 1] AS l FROM events)")
def locale_split(spark: SparkSession, sf: str) -> DataFrame:
    loc = F.get(F.array(*map(F.lit, ["us", "de_home", "fr_lab_2", "xx"])), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", migration.country(loc).alias("country"), migration.vantage(loc).alias("vantage"))


@query("SELECT p_partkey, base64(encode(p_name)) AS b64, hex(encode(p_name)) AS b16, md5(p_name) AS md5 FROM part")
def encodings(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("p_name").cast("binary")
    return table(spark, sf, "part").select("p_partkey", F.base64(raw).alias("b64"), F.hex(raw).alias("b16"), F.md5(raw).alias("md5"))


@query("SELECT n_nationkey, CAST(json_object('name', n_name, 'region', n_regionkey) AS VARCHAR) AS meta FROM nation")
def json_build(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("meta"))


@query("SELECT event_id, try_strptime(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE strftime(ts, '%Y%m%d%H%M%S') END, '%Y%m%d%H%M%S') AS stamp FROM events")
def archive_stamps(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    return table(spark, sf, "events").select("event_id", timefmt.archive_stamp(raw).alias("stamp"))


@query("SELECT p_partkey, k AS at, substr(p_name, k * 4 + 1, 4) AS chunk FROM (SELECT p_partkey, p_name, unnest(range(0, greatest(1, CAST(ceil(length(p_name) / 4.0) AS BIGINT)))) AS k FROM part)")
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.posexplode(text.chunks(F.col("p_name"), 4)).alias("at", "chunk")).withColumn("at", F.col("at").cast("long"))


@query("SELECT c_custkey, len(list_append(string_split(c_name, '#'), 'end')) AS n, list_append(string_split(c_name, '#'), 'end')[-1] AS last FROM customer")
def array_append(spark: SparkSession, sf: str) -> DataFrame:
    a = F.array_append(F.split("c_name", "#"), "end")
    return table(spark, sf, "customer").select("c_custkey", F.size(a).cast("long").alias("n"), F.element_at(a, -1).alias("last"))


@query("SELECT c_mktsegment, max_by(c_name, (c_acctbal, c_custkey)) AS last, count(*) AS n FROM customer GROUP BY 1")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("last"), F.count("*").alias("n"))


_WORDS = "WITH w AS (SELECT conv_id, turn, unnest([x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']) AS word FROM conversations)"


@query(_WORDS + " SELECT word, count(*) AS n, CASE word WHEN 'the' THEN 'le' WHEN 'of' THEN 'de' ELSE word END AS translated FROM w GROUP BY word")
def translation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "conversations").select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([("the", "le"), ("of", "de")], "word string, t string")
    return words.join(known, "word", "left").select("word", "n", F.coalesce("t", "word").alias("translated"))


@query(_WORDS + " SELECT count(DISTINCT length(word)) AS langs, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS chars FROM (SELECT DISTINCT word FROM w WHERE word NOT IN ('the', 'of', 'and'))")
def todo_report(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.array(F.struct(F.lit("en").alias("l"), F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("t")))
    known = spark.createDataFrame([("en", w) for w in ("the", "of", "and")], "lang string, word string")
    todo = migration.translation_todo(table(spark, sf, "conversations").filter("text is not null").select(seg.alias("segmented")), known)
    return migration.todo_report(todo.withColumn("lang", F.length("word")))


@query("SELECT user_id % 40 AS url, CASE max(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) WHEN 1 THEN 'control' WHEN 2 THEN 'sensitive' ELSE 'leak' END AS \"group\" FROM events GROUP BY 1")
def url_groups(spark: SparkSession, sf: str) -> DataFrame:
    src = F.get(F.array(*map(F.lit, ["Alexa 2014", "Herdict 2014", "Norway 2009 (Wikileaks)"])), (F.col("event_id") % 3).cast("int"))
    return migration.group_of_urls(table(spark, sf, "events").select((F.col("user_id") % 40).alias("url"), src.alias("source")))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'host not found' WHEN 2 THEN 'server unreachable' WHEN 3 THEN 'crawler failure' WHEN 4 THEN 'timeout' ELSE 'other HTTP response' END AS category FROM events")
def crawler_results(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("event_id") % 6).cast("int")
    code = F.get(F.array(*map(F.lit, ["200", "N3", "N99", "N77", "timeout", "299"])), k)
    return table(spark, sf, "events").select("event_id", status.category_a(code, F.lit("N99 Host unreachable")).alias("category"))


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 2 WHEN ts >= TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END AS mark FROM events")
def range_marks(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10", "2024-01-20"))
    return table(spark, sf, "events").select("event_id", history.in_range_mark(F.col("ts"), lo, hi).alias("mark"))


@query("SELECT e.event_id, CASE WHEN n BETWEEN 0 AND 49 THEN 'AA' WHEN n BETWEEN 100 AND 119 THEN 'BB' ELSE 'ZZ' END AS country FROM (SELECT event_id, user_id AS n FROM events) e")
def ip_countries(spark: SparkSession, sf: str) -> DataFrame:
    from skein.sources.traces import ip_country

    ranges = spark.createDataFrame([(0, 50, "AA"), (100, 120, "BB")], "lo long, hi long, country string")
    ips = table(spark, sf, "events").select("event_id", F.concat(F.lit("0.0.0."), F.col("user_id").cast("string")).alias("ip"))
    return ip_country(ips, ranges).select("event_id", "country")


@query("SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/robots.txt' AS site, regexp_matches(url, '^https?://[^/?#]+/?$') AS root FROM pages")
def robots_sites(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", url.robots_site(u).alias("site"), url.is_siteroot(u).alias("root"))


@query("SELECT doc_id, lang, max(q) AS quality FROM (SELECT d.doc_id, d.lang, CASE WHEN l.toxic = 0 THEN l.quality END AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY ALL HAVING max(q) IS NOT NULL")
def labelled_quality(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").filter("toxic = 0").select("doc_id", "quality")
    return d.join(l, "doc_id").groupBy("doc_id", "lang").agg(F.max("quality").alias("quality")).filter("quality is not null")


@query("SELECT a.url AS bad_url, b.url AS good_url FROM (SELECT upper(url) AS url, lower(url) AS c FROM pages) a JOIN pages b ON a.c = b.url")
def bad_to_good(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").filter("url = lower(url)")
    both = p.select(F.col("page_id").alias("id"), "url").unionByName(p.select((F.col("page_id") + 10_000_000).alias("id"), F.upper("url").alias("url")))
    return relational.bad_to_good(both, F.lower("url")).filter("good_id is not null").select("bad_url", F.col("good_url"))
