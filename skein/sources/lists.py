"""URL lists in the formats of their sources. Every reader gives one row for each URL, with what the source says of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.url import canonical, expand_sites, is_resource, pandas_map, wiki_url


def file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def ranked_sites(spark: SparkSession, path: str, top_n: int = 0, http_only: bool = False, www_only: bool = False) -> DataFrame:
    """url and its best rank from ``rank,site`` lines; top_n 0 is all."""
    raw = csv(spark, path, "rank int, site string", header=False)
    raw = raw.filter(F.col("rank") <= top_n) if top_n else raw
    return expand_sites(raw, "site", http_only, www_only).groupBy("url").agg(F.min("rank").alias("rank"))


# File names that stand for no country.
REGIONS = {"global": "ZZ", "cis": "XC"}


def category_lists(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """url, country, category from one CSV for each country; legends and other names are left out, countries in ``done`` too."""
    raw = spark.read.option("header", True).csv(path).withColumn("file", F.lower(F.regexp_replace(file_name(), r"(?i)\.csv$", "")))
    raw = raw.filter(F.col("file").rlike("^[a-z]{2}$|^global$|^cis$"))
    country = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv]), F.col("file")), F.upper("file"))
    out = raw.select(canonical(F.col("url")).alias("url"), country.alias("country"), F.col("category_code").alias("category")).filter("url is not null").distinct()
    return out if done is None else out.join(done.select("country"), "country", "left_anti").select("url", "country", "category")


def category_legend(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """New (code, description) rows; a wrong header is an error."""
    raw = spark.read.option("header", True).csv(path)
    if raw.columns[:2] != ["CategoryCode", "CategoryName"]:
        raise ValueError(f"unexpected header {raw.columns}")
    new = raw.select(F.col("CategoryCode").alias("code"), F.col("CategoryName").alias("description")).distinct()
    return new if known is None else new.exceptAll(known.select("code", "description").distinct())


REPORT = "url string, reportDate string, reportType string, protocol string, country struct<shortName:string>"


def access_reports(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """url, timestamp, accessible, country of saved report pages; rows from the high-water mark on."""
    raw = spark.read.schema(REPORT).option("multiLine", True).json(path)
    bare = F.regexp_replace("url", "(?i)^https?://", "")
    bare = F.when(F.instr(bare, "/") == 0, F.concat(bare, F.lit("/"))).otherwise(bare)
    url = F.concat(F.lower(F.coalesce("protocol", F.lit("HTTP"))), F.lit("://"), bare)
    at = F.coalesce(F.try_to_timestamp("reportDate", F.lit("yyyy-MM-dd'T'HH:mm:ssXX")), F.try_to_timestamp("reportDate", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    out = raw.select(canonical(url).alias("url"), at.alias("timestamp"), (F.col("reportType") != "INACCESSIBLE").alias("accessible"), F.coalesce("country.shortName", F.lit("??")).alias("country"))
    return out.filter(F.col("timestamp") > F.lit(since).cast("timestamp")) if since else out


def report_totals(reports: DataFrame) -> DataFrame:
    return reports.agg(F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"), F.count("*").alias("total"), F.count_if("accessible").alias("accessible"))


def bookmarks(spark: SparkSession, path: str, user: str) -> DataFrame:
    raw = spark.read.schema("href string, time string, description string, extended string, tags string").option("multiLine", True).json(path)
    return raw.select(F.lit(user).alias("user"), canonical(F.col("href")).alias("url"), F.try_to_timestamp("time").alias("time"), F.col("description").alias("title"), F.col("extended").alias("annotation"), "tags").distinct()


def static_list(spark: SparkSession, path: str) -> DataFrame:
    """label, source, date and url of lists with ``# Key: value`` lines before URLs or bare sites; other schemes are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    key = lambda k: F.trim(F.regexp_extract("text", rf"(?im)^#\s*{k}:\s*(.*)$", 1))
    lines = whole.select(key("Label").alias("label"), key("Source").alias("source"), F.try_to_date(key("Date")).alias("date"), F.explode(F.split("text", r"\r?\n")).alias("line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '#')")
    full = lines.filter(F.col("line").rlike("(?i)^https?://")).withColumn("url", canonical(F.col("line")))
    sites = expand_sites(lines.filter(~F.col("line").rlike(r"(?i)^[a-z][a-z0-9+.-]*://")), "line")
    return full.unionByName(sites).filter("url is not null").select("label", "source", "date", "url").distinct()


def rescan(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, "url string, result string, locales string")


def leak_list(spark: SparkSession, path: str) -> DataFrame:
    """url and the header's keys; lines without scheme are tried with and without www."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    pairs = F.regexp_extract_all("text", F.lit(r"(?m)^#\s*([A-Za-z ]+):\s*(.*)$"), F.lit(0))
    meta = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"^#\s*([A-Za-z ]+):", 1))), F.trim(F.regexp_extract(p, r":\s*(.*)$", 1)))))
    lines = whole.select(meta.alias("meta"), F.explode(F.split("text", r"\r?\n")).alias("line")).withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '#')")
    full = F.col("line").startswith("http")
    return lines.select("meta", F.explode(F.when(full, F.array("line")).otherwise(F.array(F.concat(F.lit("http://"), "line"), F.concat(F.lit("http://www."), "line")))).alias("raw")).select("meta", canonical(F.col("raw")).alias("url")).filter("url is not null")


def court_orders(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path, "domain string, date string, agency string, caseno string")
    www = F.concat(F.lit("http://www."), "domain", F.lit("/"))
    plain = F.concat(F.lit("http://"), "domain", F.lit("/"))
    urls = F.when(F.col("domain").startswith("www."), F.array(plain)).otherwise(F.array(plain, www))
    return raw.select(F.explode(urls).alias("raw"), F.to_json(F.struct("date", "agency", "caseno")).alias("meta")).select(canonical(F.col("raw")).alias("url"), "meta").filter("url is not null")


def court_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of saved table pages ``{"data": [[cell, ...], ...]}``: HTML goes from the first cell, dates are turned round."""
    raw = spark.read.schema("data array<array<string>>").option("multiLine", True).json(path).select(F.explode("data").alias("r"))
    return raw.select(F.trim(F.regexp_replace(F.get("r", F.lit(0)), "<[^>]*>", "")).alias("domain"), F.to_date(F.get("r", F.lit(1)), "dd.MM.yyyy").alias("date"), F.get("r", F.lit(2)).alias("agency"), F.get("r", F.lit(3)).alias("caseno"))


def blocked_tags(spark: SparkSession, path: str, fixes: dict[str, list[str]] | None = None) -> DataFrame:
    """url and its tags, corrected, joined with a bar: column 0 is the URL, 4 the status, 8 the tag."""
    raw = spark.read.option("header", False).csv(path).filter(F.lower("_c4") == "blocked")
    fixes = {k: v for k, v in (fixes or {}).items()}
    tag = F.trim(F.lower("_c8"))
    table = F.create_map(*[F.lit(k) if i == 0 else F.array(*map(F.lit, v)) for k, v in fixes.items() for i in (0, 1)]) if fixes else None
    tags = F.coalesce(F.try_element_at(table, tag), F.array(tag)) if fixes else F.array(tag)
    per = raw.select(canonical(F.col("_c0")).alias("url"), F.explode(tags).alias("tag")).filter("url is not null and tag <> ''")
    return per.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


def proxy_sample(spark: SparkSession, path: str) -> DataFrame:
    """count and url of ``count tag url`` lines that the policy denied, files of resources left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(p, F.lit(0)).try_cast("long").alias("count"), F.get(p, F.lit(1)).alias("tag"), F.get(p, F.lit(2)).alias("url"), F.size(p).alias("n"))
    return rows.filter((F.col("n") == 3) & F.col("count").isNotNull() & (F.col("tag") == "policy_denied") & ~is_resource(F.col("url"))).select("count", canonical(F.col("url")).alias("url")).filter("url is not null")


def wiki_links(spark: SparkSession, path: str) -> DataFrame:
    """lang, page, page_url and link; the language is the last part of the file's name."""
    raw = spark.read.schema("page string, link string").option("header", True).csv(path).withColumn("lang", F.regexp_extract(file_name(), r"([a-z]{2,3})\.csv$", 1))
    return raw.select("lang", "page", wiki_url(F.col("lang"), F.col("page")).alias("page_url"), canonical(F.col("link")).alias("link")).filter("link is not null")


def wiki_extlinks(spark: SparkSession, path: str) -> DataFrame:
    """page, link and missing of saved answers of the link API."""
    kind = "query struct<pages:map<string,struct<title:string,missing:string,extlinks:array<map<string,string>>>>>"
    pages = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode(F.map_values("query.pages")).alias("p"))
    return pages.select(F.col("p.title").alias("page"), F.explode_outer("p.extlinks").alias("l"), F.col("p.missing").isNotNull().alias("missing")).select("page", F.get(F.map_values("l"), F.lit(0)).alias("link"), "missing")


def merged_lists(spark: SparkSession, path: str) -> DataFrame:
    """Canonical URLs of all cells of all lines that begin with http, resources left out, sorted."""
    cells = spark.read.text(path).select(F.explode(F.split("value", r"[,\t]")).alias("c")).withColumn("c", F.trim(F.regexp_replace("c", '^"|"$', ""))).filter("startswith(c, 'http')")
    return cells.select(canonical(F.col("c")).alias("url")).filter("url is not null").filter(~is_resource(F.col("url"))).distinct().orderBy("url")


ARCHIVED = (200, 301, 302, 303, 307, 308)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """url and time of ``original timestamp status`` lines of pages that were there; bad lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(p, F.lit(0)).alias("url"), F.try_to_timestamp(F.get(p, F.lit(1)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("time"), F.get(p, F.lit(2)).try_cast("int").alias("status"))
    return rows.filter(F.col("status").isin(*ARCHIVED) & F.col("time").isNotNull()).select("url", "time")


def hostnames(spark: SparkSession, path: str) -> DataFrame:
    """name and address of lines ``name (addr)`` with # comments, valid names only, ordered by labels from the right."""
    from skein.functions.url import dns_name

    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(line.alias("l")).filter("l <> ''")
    rows = rows.select(pandas_map(dns_name, "string")(F.regexp_extract("l", r"^(\S+)", 1)).alias("name"), F.nullif(F.regexp_extract("l", r"\(([^)]*)\)", 1), F.lit("")).alias("address")).filter("name is not null")
    return rows.distinct().orderBy(F.reverse(F.split("name", r"\.")))


def dns_servers(spark: SparkSession, path: str) -> DataFrame:
    """loc and its addresses; a word that is no address is an error."""
    from skein.functions.url import is_ip

    p = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter(F.get("p", F.lit(0)) != "").select(F.get("p", F.lit(0)).alias("loc"), F.explode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("server"))
    ok = is_ip(F.col("server")) | F.col("server").rlike("^[0-9A-Fa-f:]+$")
    return rows.withColumn("server", F.when(ok, F.col("server")).otherwise(F.raise_error(F.concat(F.lit("not an address: "), "server")).cast("string"))).groupBy("loc").agg(F.array_sort(F.collect_set("server")).alias("servers"))


def proxy_config(spark: SparkSession, path: str) -> DataFrame:
    """loc, method, args of each line; a location that occurs twice or is no name is an error."""
    p = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).filter(F.get("p", F.lit(0)) != "")
    rows = rows.select(F.get("p", F.lit(0)).alias("loc"), F.get("p", F.lit(1)).alias("method"), F.slice("p", F.lit(3), F.greatest(F.size("p") - 2, F.lit(0))).alias("args"))
    per = rows.groupBy("loc").agg(F.count("*").alias("n"), F.first("method").alias("method"), F.first("args").alias("args"))
    good = (F.col("n") == 1) & F.col("loc").rlike("^[a-z]{2}(?:_[a-z0-9_]+)?$")
    return per.withColumn("loc", F.when(good, F.col("loc")).otherwise(F.raise_error(F.concat(F.lit("bad or repeated location: "), "loc")).cast("string"))).drop("n")


def translations(spark: SparkSession, path: str) -> DataFrame:
    """lang, word, engl of one CSV for each language; of a word in several files the last file's."""
    from skein.functions.text import unescape

    raw = spark.read.schema("word string, engl string").option("header", True).csv(path).withColumns({"file": F.col("_metadata.file_path"), "lang": F.regexp_extract(file_name(), r"([A-Za-z-]+)\.csv$", 1)})
    own = raw.select("lang", unescape(F.col("word")).alias("word"), unescape(F.col("engl")).alias("engl"), "file").dropDuplicates()
    return own.groupBy("lang", "word").agg(F.max_by("engl", F.struct("file", "engl")).alias("engl"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def size_clusters(spark: SparkSession, path: str) -> DataFrame:
    """country, length, count of ``country,_,length:count;...`` lines."""
    raw = csv(spark, path, "country string, other string, clusters string", header=False)
    cell = F.split("c", ":")
    return raw.select("country", F.explode(F.split("clusters", ";")).alias("c")).filter("c <> ''").select("country", F.get(cell, F.lit(0)).try_cast("long").alias("length"), F.get(cell, F.lit(1)).try_cast("long").alias("count"))


def public_suffixes(spark: SparkSession, path: str) -> frozenset[str]:
    """Rules of a list; a file of fixed size that every worker needs."""
    from skein.functions.url import read_suffixes

    return read_suffixes(r["value"] for r in spark.read.text(path).toLocalIterator())


def dimension(spark: SparkSession, rows: list[tuple], schema: str, key: list[str]) -> DataFrame:
    """A small literal table; a key that occurs twice is an error."""
    keys = [tuple(r[: len(key)]) for r in rows]
    if len(set(keys)) != len(keys):
        raise ValueError("repeated key in a dimension")
    return spark.createDataFrame(rows, schema)


def run_tables(spark: SparkSession, database: str, prefix: str = "urls_", exclude: list[str] | None = None) -> list[str]:
    """Names of a run's tables from the catalog."""
    return sorted(t.name for t in spark.catalog.listTables(database) if t.name.startswith(prefix) and t.name not in (exclude or []))
