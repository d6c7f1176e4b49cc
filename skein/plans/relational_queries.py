"""Queries on relational shapes: filters, joins, aggregates, set operations, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import relational as rel
from skein.plans.registry import query, table


def tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


@query("SELECT o_orderstatus, median(o_totalprice) AS median_price, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY 1")
def median_by_group(spark: SparkSession, sf: str) -> DataFrame:
    p = "o_totalprice"
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.median(p).alias("median_price"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.count("*").alias("n"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_ordered(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.distinct_on(o, ["o_custkey"], [-F.col("o_totalprice"), "o_orderkey"])


@query("SELECT l_returnflag, l_linestatus, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def distinct_on_any(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey")
    return rel.distinct_on(li, ["l_returnflag", "l_linestatus"], ["l_orderkey"])


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey BETWEEN 3 AND 20 AND r_name IN ('ASIA', 'EUROPE', 'AMERICA') AND n_name NOT IN ('CHINA') AND NOT (n_name LIKE '%NIA')")
def filters_basic(spark: SparkSession, sf: str) -> DataFrame:
    n, r = tables(spark, sf, "nation", "region")
    c = F.col
    keep = c("n_nationkey").between(3, 20) & c("r_name").isin("ASIA", "EUROPE", "AMERICA") & ~c("n_name").isin("CHINA") & ~c("n_name").like("%NIA")
    return n.join(r, c("n_regionkey") == c("r_regionkey")).filter(keep).select("n_name", "r_name")


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE octet_length(encode(text)) BETWEEN 1 AND 512 AND text IS NOT NULL AND len(string_split(text, ' ')) > 0")
def filters_length(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf, "documents").filter(size.between(1, 512) & (F.size(F.split("text", " ")) > 0)).select("doc_id", F.length("text").cast("long").alias("chars"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'error' THEN 'fault' END AS kind, coalesce(nullif(event_type, 'signup'), 'new') AS name FROM events")
def case_remap(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e.isin("view", "click"), "read").when(e == "error", "fault")
    return table(spark, sf, "events").select("event_id", kind.alias("kind"), F.coalesce(F.nullif(e, F.lit("signup")), F.lit("new")).alias("name"))


@query(
    "SELECT l_orderkey, l_linenumber, c_name, cn.n_name AS cust_nation, s_name, sn.n_name AS supp_nation, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
    " JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE o_orderstatus = 'F'"
)
def star_view_inner7(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c, s, p, n = tables(spark, sf, "lineitem", "orders", "customer", "supplier", "part", "nation")
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation"))
    out = li.join(o.filter("o_orderstatus = 'F'"), li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    return out.join(cn, "c_nationkey").join(sn, "s_nationkey").select("l_orderkey", "l_linenumber", "c_name", "cust_nation", "s_name", "supp_nation", "p_name")


@query(
    "SELECT doc_id, quality, toxic, substr(page.url, 1, 200) AS url, item_id, event_type, n_name FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages page ON page.page_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id"
    " LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN customer c ON c.c_custkey = d.doc_id LEFT JOIN nation ON n_nationkey = c_nationkey"
)
def star_view_left6(spark: SparkSession, sf: str) -> DataFrame:
    d, l, p, b, e, c, n = tables(spark, sf, "documents", "labels", "pages", "benchmark", "events", "customer", "nation")
    out = d.join(l, "doc_id", "left").join(p, F.col("page_id") == d.doc_id, "left").join(b.select("item_id"), F.col("item_id") == d.doc_id, "left")
    out = out.join(e, F.col("event_id") == d.doc_id, "left").join(c, F.col("c_custkey") == d.doc_id, "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("doc_id", "quality", "toxic", F.substring("url", 1, 200).alias("url"), "item_id", "event_type", "n_name")


@query("SELECT n.n_name, c.lc2, c.name FROM nation n LEFT JOIN (VALUES ('FR', 'FRA', 'one'), ('GE', 'GER', 'two'), ('XX', 'JAP', 'three')) c(lc2, lc3, name) ON substr(n.n_name, 1, 2) = c.lc2 OR substr(n.n_name, 1, 3) = c.lc3")
def theta_or_join(spark: SparkSession, sf: str) -> DataFrame:
    codes = spark.createDataFrame([("FR", "FRA", "one"), ("GE", "GER", "two"), ("XX", "JAP", "three")], "lc2 string, lc3 string, name string")
    n = table(spark, sf, "nation").withColumn("k", F.explode(F.array(F.substring("n_name", 1, 2), F.substring("n_name", 1, 3))))
    hit = rel.or_join(n, codes, "k", ["lc2", "lc3"]).filter((F.col("k") == F.col("lc2")) | (F.col("k") == F.col("lc3"))).select("n_name", "lc2", "name").distinct()
    return table(spark, sf, "nation").select("n_name").join(hit, "n_name", "left")


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN l.quality END AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1")
def left_constant_on(spark: SparkSession, sf: str) -> DataFrame:
    d, l = tables(spark, sf, "documents", "labels")
    return d.select("doc_id").join(l.filter("toxic = 1").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    d, l = tables(spark, sf, "documents", "labels")
    return d.join(l, "doc_id", "left_anti").select("doc_id")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
def not_exists(spark: SparkSession, sf: str) -> DataFrame:
    c, o = tables(spark, sf, "customer", "orders")
    big = o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def not_in_rowvalue(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.join(li.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_in(spark: SparkSession, sf: str) -> DataFrame:
    o, c, li = tables(spark, sf, "orders", "customer", "lineitem")
    out = o.join(c.filter("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return out.join(li.filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
def row_in(spark: SparkSession, sf: str) -> DataFrame:
    want = spark.createDataFrame([("A", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return table(spark, sf, "lineitem").join(want, ["l_returnflag", "l_linestatus"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("WITH m AS (SELECT TIMESTAMP '2024-01-08' AS lo, TIMESTAMP '2024-01-20' AS hi) SELECT event_id, ts FROM events, m WHERE ts >= lo AND ts < hi")
def cross_param(spark: SparkSession, sf: str) -> DataFrame:
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-08", "2024-01-20"))
    return table(spark, sf, "events").filter((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id", "ts")


@query("SELECT a.page_id, b.page_id AS twin_id FROM pages a JOIN pages b ON regexp_extract(a.url, '^https?://([^/?#]+)', 1) = regexp_extract(b.url, '^https?://([^/?#]+)', 1) AND a.page_id < b.page_id")
def self_join_remap(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    p = table(spark, sf, "pages").select("page_id", host.alias("host"))
    return p.join(p.select(F.col("page_id").alias("twin_id"), "host"), "host").filter("page_id < twin_id").select("page_id", "twin_id")


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON n_nationkey = c_nationkey")
def update_from(spark: SparkSession, sf: str) -> DataFrame:
    c, n = tables(spark, sf, "customer", "nation")
    own = n.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return rel.update_from(c.select("c_custkey", "c_nationkey", "c_mktsegment"), own, ["c_nationkey"], {"c_mktsegment": "n_name"}).select("c_custkey", "c_mktsegment")


@query("SELECT text, CAST(row_number() OVER (ORDER BY text) AS BIGINT) AS id FROM (SELECT DISTINCT md5(text) AS text FROM documents)")
def intern_ids(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("text"))
    return rel.intern(keys, "text").select("text", F.col("id").cast("long").alias("id"))


@query("WITH n AS (SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 10000000, quality, toxic FROM labels WHERE doc_id % 5 = 0) SELECT coalesce(n.doc_id, l.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN l.quality ELSE n.quality END AS quality, CASE WHEN n.doc_id IS NULL THEN l.toxic ELSE n.toxic END AS toxic FROM labels l FULL OUTER JOIN n ON l.doc_id = n.doc_id")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    new = l.filter("doc_id % 3 = 0").withColumn("quality", (1 - F.col("quality")).cast("int")).unionByName(l.filter("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000))
    return rel.upsert(l, new, ["doc_id"])


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15')")
def delta_replicate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return rel.delta(e, e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), ["event_id"]).select("event_id", "user_id")


@query("SELECT url, CAST(row_number() OVER (ORDER BY o, url) AS BIGINT) AS new_id FROM (SELECT url, min(CASE WHEN url LIKE 'https:%' THEN 0 ELSE 1 END) AS o FROM pages GROUP BY url)")
def renumber_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("url")
    https = F.col("url").like("https:%")
    return rel.renumber_first_seen([p.filter(https), p.filter(~https)], "url").select("url", F.col("new_id").cast("long").alias("new_id"))


@query("SELECT user_id % 20 AS fine, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def result_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rel.inconsistent(table(spark, sf, "events").withColumn("fine", F.col("user_id") % 20), "fine", "event_type")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 0")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    n, r = tables(spark, sf, "nation", "region")
    names = n.select(F.col("n_name").alias("name"))
    return names.unionByName(r.select(F.col("r_name").alias("name"))).unionByName(n.filter("n_regionkey = 0").select(F.col("n_name").alias("name")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    c, s = tables(spark, sf, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def except_rows(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tables(spark, sf, "orders", "customer")
    return o.select(F.col("o_custkey").alias("k")).subtract(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_rows(spark: SparkSession, sf: str) -> DataFrame:
    c, s = tables(spark, sf, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS BIGINT) AS val FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_explode(spark: SparkSession, sf: str) -> DataFrame:
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select("event_id", F.explode(m).alias("key", "val"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, CAST(ceil(epoch(ts) / 86400) AS BIGINT) AS day_up, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def epoch_convert(spark: SparkSession, sf: str) -> DataFrame:
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    exact = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf, "events").select("event_id", secs.alias("secs"), F.floor(exact / 86400).alias("day"), F.ceil(exact / 86400).alias("day_up"), F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"))


@query("WITH d AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events WHERE event_type = 'signup'), (SELECT max(ts)::DATE FROM events WHERE event_type = 'signup'), INTERVAL 1 DAY))::DATE AS day) SELECT day, count(e.event_id) AS n FROM d LEFT JOIN events e ON e.ts::DATE = day AND event_type = 'signup' GROUP BY day")
def events_per_day_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    return rel.zero_filled_days(table(spark, sf, "events").filter("event_type = 'signup'"), "ts")


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS big FROM orders GROUP BY 1")
def counts_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") > 100000).alias("big"))


@query("SELECT e.event_id, r.part FROM events e JOIN (VALUES (10, 60, 'a'), (50, 90, 'b'), (200, 201, 'c')) r(lo, hi, part) ON e.user_id >= r.lo AND e.user_id < r.hi")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.createDataFrame([(10, 60, "a"), (50, 90, "b"), (200, 201, "c")], "lo long, hi long, part string")
    return rel.range_join(table(spark, sf, "events"), r, "user_id", "lo", "hi", 16).select("event_id", "part")


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS tags, count(*) AS n FROM part GROUP BY p_brand")
def tag_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("tags"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(avg(n), 6) AS mean, median(n) AS median, mode(n ORDER BY n) AS mode, round(var_samp(n), 6) AS variance, round(stddev_pop(n), 6) AS pstdev, max(n) AS max FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def counter_stats(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("o_orderpriority").agg(
        F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.mode("n", True).alias("mode"), F.round(F.var_samp("n"), 6).alias("variance"), F.round(F.stddev_pop("n"), 6).alias("pstdev"), F.max("n").alias("max")
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS BIGINT) AS n FROM orders")
def global_row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    out = rel.row_numbers(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def max_over_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey")).alias("top"))
