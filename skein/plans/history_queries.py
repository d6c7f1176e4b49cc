"""Queries on histories, runs and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import history as h
from skein.operators import relational as rel
from skein.operators import sampling
from skein.plans.registry import query, table

#: events as a page history: user_id is the URL; view is ok, purchase a parked page.
HISTORY = "hist AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'ok' ELSE event_type END AS result, event_type = 'purchase' AS is_parked FROM events)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf, "events").select("user_id", "ts", "event_id", F.when(e.isin("view", "purchase"), "ok").otherwise(e).alias("result"), (e == "purchase").alias("is_parked"))


@query(
    f"WITH {HISTORY}, f AS (SELECT user_id, arg_min(result, (ts, result)) AS r, arg_min(is_parked, (ts, result)) AS p, min(ts) AS start, max(ts) AS last FROM hist GROUP BY user_id),"
    " k AS (SELECT * FROM f WHERE r = 'ok' AND NOT p), c AS (SELECT user_id, min((hist.ts, is_parked, result)) AS c FROM hist JOIN k USING (user_id) WHERE result <> r OR is_parked <> p GROUP BY user_id)"
    " SELECT user_id, start, CASE WHEN c IS NULL THEN last ELSE c[1] END AS end, round((epoch_us(CASE WHEN c IS NULL THEN last ELSE c[1] END) - epoch_us(start)) / 1e6, 3) AS seconds,"
    " CASE WHEN c IS NULL THEN 'unchanged' WHEN c[2] THEN 'parked' ELSE c[3] END AS change FROM k LEFT JOIN c USING (user_id)"
)
def change_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return h.change_intervals(history(spark, sf), "user_id").withColumn("seconds", F.round("seconds", 3))


@query("SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 31556952, 9) AS years FROM events")
def years_since_first(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return table(spark, sf, "events").select("event_id", F.round((h.seconds(F.col("ts")) - h.seconds(first)) / h.YEAR_S, 9).alias("years"))


@query("SELECT conv_id, turn, prev, role FROM (SELECT conv_id, turn, role, lag(role) OVER w AS prev, lag(turn) OVER w AS pt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE pt IS NOT NULL AND prev IS DISTINCT FROM role")
def change_points_lag(spark: SparkSession, sf: str) -> DataFrame:
    return h.change_points(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "prev", "role")


THIN_SQL = """
WITH RECURSIVE a AS (SELECT o_custkey AS k, o_orderdate AS t FROM orders), b AS (SELECT k, min(t) AS mn, max(t) AS mx, TIMESTAMP '1994-01-01' AS lo, TIMESTAMP '1997-01-01' AS hi FROM a GROUP BY k),
s AS (SELECT k, lo, hi, mx, coalesce((SELECT max(t) FROM a WHERE a.k = b.k AND t <= lo), mn) AS st FROM b),
g AS (SELECT k, st AS t FROM s UNION ALL SELECT g.k, (SELECT min(a.t) FROM a, s WHERE a.k = g.k AND s.k = g.k AND a.t < s.hi AND a.t >= g.t + INTERVAL 30 DAY) AS t FROM g WHERE g.t IS NOT NULL),
l AS (SELECT s.k, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.k = s.k AND a.t > st AND a.t >= hi) THEN coalesce((SELECT max(t) FROM a WHERE a.k = s.k AND t > st AND t < hi), st) ELSE mx END AS t FROM s),
u AS (SELECT k, t FROM g WHERE t IS NOT NULL UNION SELECT k, t FROM l)
SELECT k AS o_custkey, t AS snapshot FROM u"""


@query(THIN_SQL)
def snapshot_thinning_30d(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderdate").alias("a"))
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1994-01-01", "1997-01-01"))
    return per.select("o_custkey", F.explode(h.thin(F.col("a"), lo, hi)).alias("snapshot")).distinct()


@query("SELECT c.c_custkey, m.mark, o.o_orderkey FROM customer c CROSS JOIN (VALUES (TIMESTAMP '1993-06-01'), (TIMESTAMP '1995-06-01'), (TIMESTAMP '1997-06-01')) m(mark) ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON c.c_custkey = o.o_custkey AND m.mark >= o.o_orderdate")
def asof_yearly_samples(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.array(*[F.lit(x).cast("timestamp_ntz") for x in ("1993-06-01", "1995-06-01", "1997-06-01")])
    left = table(spark, sf, "customer").select("c_custkey", F.explode(marks).alias("mark"))
    right = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("mark")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return rel.asof(left, right, ["c_custkey"], "mark", "o_orderkey")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn DESC) AS roles FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS DISTINCT FROM role GROUP BY conv_id")
def squeeze_repeats(spark: SparkSession, sf: str) -> DataFrame:
    arr = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(arr.alias("r"))
    return per.select("conv_id", F.array_join(h.squeeze(F.col("r")), ">").alias("roles"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 25")
def cap_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).filter("r <= 25").select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)")
def runs_gt_one(spark: SparkSession, sf: str) -> DataFrame:
    return h.repeated_keys(table(spark, sf, "events"), "user_id").select("event_id")


@query("SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS dt_us FROM events")
def delta_per_direction(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).alias("dt_us"))


@query("SELECT user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) AS prio FROM events GROUP BY user_id")
def group_priority(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(p).alias("prio"))


@query(
    "WITH f AS (SELECT min(ts) AS z FROM events), c AS (SELECT event_type AS what, CAST(ceil((epoch_us(ts) - epoch_us(z)) / 1e6 / 86400) AS INTEGER) AS day FROM events, f WHERE event_type IN ('error', 'signup', 'purchase')),"
    " b AS (SELECT day, what, count(*) AS k FROM c GROUP BY ALL), g AS (SELECT d.day, w.what FROM (SELECT unnest(generate_series(0, (SELECT max(day) FROM c)))::INTEGER AS day) d, (SELECT DISTINCT what FROM c) w),"
    " cum AS (SELECT g.day, g.what, CAST(sum(coalesce(k, 0)) OVER (PARTITION BY g.what ORDER BY g.day) AS BIGINT) AS n FROM g LEFT JOIN b USING (day, what))"
    " SELECT day, what, n FROM cum UNION ALL SELECT day, 'original', CAST((SELECT count(*) FROM c) - sum(n) AS BIGINT) FROM cum GROUP BY day"
)
def area_bins_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    z = e.agg(F.min("ts").alias("z"))
    own = e.filter(F.col("event_type").isin("error", "signup", "purchase")).crossJoin(z)
    return h.area_bins(own.select(F.col("event_type").alias("what"), (h.seconds(F.col("ts")) - h.seconds(F.col("z"))).alias("seconds")))


@query(
    "WITH s AS (SELECT user_id, event_type AS f, lead(event_type) OVER w AS t, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),"
    " h AS (SELECT f, sum(dt) AS held FROM s WHERE t IS NOT NULL GROUP BY f) SELECT f AS \"from\", t AS \"to\", count(*) AS n FROM s WHERE t IS NOT NULL GROUP BY ALL"
)
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return h.transition_counts(table(spark, sf, "events"), "user_id", "event_id", "event_type").select("from", "to", "n")


@query("SELECT user_id, ts AS start, na AS stop FROM (SELECT user_id, event_id, ts, event_type, lead(event_type) OVER w AS nw, lead(ts) OVER w AS na FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND nw = 'click'")
def start_stop_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    out = h.session_pairs(e, "user_id", "at", "event_type", "view", "click")
    return out.select("user_id", F.col("start.ts").alias("start"), F.col("stop.ts").alias("stop"))


@query("SELECT user_id, list_reduce(list(CAST(value AS DOUBLE) ORDER BY event_id), lambda a, x: a + 2.0e0 / 11 * (x - a)) AS ewma FROM events GROUP BY user_id")
def ewma(spark: SparkSession, sf: str) -> DataFrame:
    return h.ewma(table(spark, sf, "events"), "user_id", "event_id", "value")


@query()
def topic_runs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("text", F.concat(F.lit("en,"), F.coalesce(F.lower("text"), F.lit(""))))
    return h.topic_runs(c, "conv_id", "turn", "text")


@query()
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_ids(table(spark, sf, "events"), "event_id", 200, seed=7)


@query()
def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.weighted(table(spark, sf, "events"), "event_id", F.col("value"), 200, seed=7)


@query()
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_by_day(table(spark, sf, "events"), "ts", "user_id", 500, seed=7)


@query()
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.capped(table(spark, sf, "events"), "user_id", "event_id", 25, 1000, seed=7)
