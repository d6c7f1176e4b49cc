"""Network traces: traceroute hops, worker logs, TLS records, resolver and page baselines, tweets."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGES = "trace string, me string, dest string, src string, dst string"
_START = re.compile(r"tracelb from (\S+) to ([^\s,]+),")


def hop_edges(text: str) -> list[tuple[str, str, str, str]]:
    """(from host, to host, src, dst) of each hop; an unknown hop gets its depth as a name, the first one is the host."""
    out, me, dest, depth = [], None, None, 0
    for line in text.splitlines():
        if m := _START.match(line):
            me, dest, depth = m[1], m[2], 0
            continue
        hops = line.strip().split(" -> ")
        if me is None or len(hops) < 2:
            continue
        if depth == 0 and hops[0] == "*":
            hops[0] = me
        names = []
        for i, h in enumerate(hops):
            own = h[1:-1].split(", ") if h.startswith("(") else [h]
            names.append([f"*{depth + i}" if x == "*" else x for x in own])
        out += [(me, dest, a, b) for left, right in zip(names, names[1:]) for a in left for b in right]
        depth += len(hops) - 1
    return out


def traceroutes(spark: SparkSession, path: str) -> DataFrame:
    """Edges of all trace files; a file is read whole, as a trace runs over many lines."""
    files = spark.read.text(path, wholetext=True).select("value")

    def run(batches):
        for pdf in batches:
            rows = [(f"{me}>{to}", me, to, a, b) for t in pdf["value"] for me, to, a, b in dict.fromkeys(hop_edges(t))]
            yield pd.DataFrame(rows, columns=["trace", "me", "dest", "src", "dst"])

    return files.mapInPandas(run, EDGES)


_LOG = r"^(\d+(?:\.\d+)?) (start|stop) \(\d+, (u?'(?:[^'\\]|\\.)*'|u?\"(?:[^\"\\]|\\.)*\")\)"


def worker_log(spark: SparkSession, path: str) -> DataFrame:
    """port, start, stop, url of the pages that workers loaded: a stop that follows the start of the same URL."""

    def literal(s: str | None) -> str | None:
        try:
            return ast.literal_eval(s) if s else None
        except (ValueError, SyntaxError):
            return None

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                lines = text.splitlines()
                port = re.search(r"worker (\S+) using port (\d+)", lines[0]) if lines else None
                if not port:
                    continue
                begun = None
                for line in lines[1:]:
                    m = re.match(_LOG, line)
                    url = literal(m[3]) if m else None
                    if url is None:
                        continue
                    if m[2] == "start":
                        begun = (float(m[1]), url)
                    elif begun and begun[1] == url and float(m[1]) >= begun[0]:
                        rows.append((int(port[2]), begun[0], float(m[1]), url))
                        begun = None
            yield pd.DataFrame(rows, columns=["port", "start", "stop", "url"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "port int, start double, stop double, url string")


def tls_records(spark: SparkSession, path: str) -> DataFrame:
    """session, direction, type, version, length, dt of fixed-place lines ``ssss d yy v.v llll tt.tttt``, and the time since the session's last of the direction."""
    p = F.split(F.trim("value"), r"\s+")
    g = lambda i, kind: F.get(p, F.lit(i)).try_cast(kind)
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(g(0, "long").alias("session"), F.get(p, F.lit(1)).alias("direction"), g(2, "int").alias("type"), F.get(p, F.lit(3)).alias("version"), g(4, "int").alias("length"), g(5, "double").alias("dt")).filter("session is not null")


def record_gaps(records: DataFrame, at: str = "ts") -> DataFrame:
    w = Window.partitionBy("session", "direction").orderBy(at)
    return records.withColumn("gap", F.col(at) - F.lag(at).over(w))


BASELINE = (
    "meta map<string,string>, baseline array<struct<dns:map<string,array<struct<request:string,response1:string,response2:string,`response1-ips`:array<string>,`response2-ips`:array<string>,nameserver:string>>>,"
    "http:map<string,struct<response:struct<status:int,reason:string,body:string,failure:string,headers:map<string,string>>,"
    "redirects:map<string,struct<request:struct<url:string>,response:struct<status:int,reason:string,body:string,failure:string,headers:map<string,string>>>>>>>>"
)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Measurement files as typed rows; unknown keys are skipped, broken files give nulls."""
    return spark.read.schema(BASELINE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def baseline_meta(df: DataFrame) -> DataFrame:
    return df.select(F.explode("meta").alias("key", "value"))


def baseline_dns(df: DataFrame, raw: bool = False) -> DataFrame:
    """host, nameserver, address (or the two answers as they came)."""
    hosts = df.select(F.explode("baseline").alias("b")).select(F.explode("b.dns").alias("host", "answers")).select("host", F.explode("answers").alias("a"))
    if raw:
        return hosts.select("host", "a.nameserver", "a.request", "a.response1", "a.response2")
    none = F.array().cast("array<string>")
    ips = F.array_distinct(F.concat(F.coalesce("a.response1-ips", none), F.coalesce("a.response2-ips", none)))
    return hosts.select("host", F.col("a.nameserver").alias("nameserver"), F.explode_outer(ips).alias("address"))


def status_text(r: Column) -> Column:
    """A failure, ``status reason``, or question marks for what is missing."""
    code = F.when(r["status"].isNotNull(), F.concat_ws(" ", r["status"].cast("string"), r["reason"])).when(r["reason"].isNotNull(), F.concat(F.lit("??? "), r["reason"]))
    return F.coalesce(r["failure"], code, F.lit("???"))


def baseline_http(df: DataFrame) -> DataFrame:
    """url, hop, full_url, status, body: a row for each hop of a redirect chain, the page itself as hop t; bodies that only repeat the last hop's are null."""
    pages = df.select(F.explode("baseline").alias("b")).select(F.explode("b.http").alias("url", "p"))
    top = pages.select("url", F.lit("t").alias("hop"), F.col("url").alias("full_url"), F.col("p.response").alias("r")).filter("r is not null")
    hops = pages.select("url", F.explode("p.redirects").alias("hop", "h")).select("url", "hop", F.coalesce("h.request.url", "url").alias("full_url"), F.col("h.response").alias("r"))
    rows = hops.unionByName(top)
    w = Window.partitionBy("url").orderBy(F.when(F.col("hop") == "t", F.lit(1 << 30)).otherwise(F.col("hop").try_cast("int"))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last, at = F.last("r.body").over(w), F.last("hop").over(w)
    body = F.when((F.col("hop") != at) & (F.col("r.body") == last), F.lit(None)).otherwise(F.col("r.body"))
    return rows.withColumn("body", body).select("url", "hop", "full_url", status_text(F.col("r")).alias("status"), "body")


TWEET = (
    "id long, user struct<id:long,created_at:string,verified:boolean,protected:boolean,screen_name:string,name:string,lang:string,location:string,description:string>, "
    "entities struct<urls:array<struct<expanded_url:string,url:string>>,hashtags:array<struct<text:string>>>, lang string, possibly_sensitive boolean, withheld_copyright boolean, "
    "withheld_in_countries array<string>, retweet_count long, created_at string, text string"
)


def tweets(df: DataFrame) -> DataFrame:
    """Tweets with URLs, a row for each URL: hashtags and withholding countries joined with bars, copyright as ZZ."""
    good = df.filter("id is not null and user is not null and entities is not null and size(entities.urls) > 0")
    none = F.array().cast("array<string>")
    tags = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("entities.hashtags", F.array().cast("array<struct<text:string>>")), lambda h: F.lower(h["text"])))), "|")
    held = F.concat(F.coalesce("withheld_in_countries", none), F.when(F.col("withheld_copyright"), F.array(F.lit("ZZ"))).otherwise(none))
    return good.select(
        "id", F.col("user.id").alias("uid"), "created_at", F.coalesce("retweet_count", F.lit(0)).alias("retweets"), F.coalesce("possibly_sensitive", F.lit(False)).alias("possibly_sensitive"), "lang",
        F.array_join(F.array_sort(F.array_distinct(held)), "|").alias("withheld"), tags.alias("hashtags"), F.explode(F.transform("entities.urls", lambda u: F.coalesce(u["expanded_url"], u["url"]))).alias("url"),
    )


def har_final(log: Column, start: Column) -> Column:
    """struct(url, status) at the end of the redirects of a HAR log."""
    from skein.functions.url import final_status

    def one(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for text, url in zip(a, b):
            try:
                rows.append(final_status(json.loads(text)["log"]["entries"], url))
            except (ValueError, KeyError, TypeError):
                rows.append((url, None))
        return pd.DataFrame(rows, columns=["url", "status"])

    one.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(one, "url string, status int")(log, start)


def ip_country(hops: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """hops with the country of their address by (lo, hi, country) ranges of numbers, hi excluded; ZZ where none fits."""
    from skein.functions.status import ip_number
    from skein.operators.relational import range_join

    own = hops.withColumn("__n", ip_number(F.col(ip)))
    hit = range_join(own.select(ip, "__n").distinct().filter("__n is not null"), ranges, "__n", "lo", "hi", 1 << 16).groupBy(ip).agg(F.min("country").alias("country"))
    return own.drop("__n").join(hit, ip, "left").withColumn("country", F.coalesce("country", F.lit("ZZ")))
