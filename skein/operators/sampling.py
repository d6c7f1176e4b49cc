"""Reproducible samples: seeds and row keys decide, not partitions, so reruns and retries agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the columns and the seed."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))


def random_ids(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same for the same seed; ids that do not exist are never drawn. Order and limit run as a top-k."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def weighted(df: DataFrame, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances by weight (Efraimidis & Spirakis: highest log(u) / w)."""
    score = F.log(unit_hash(key, seed=seed)) / weight
    return df.filter(weight > 0).withColumn("__s", score).orderBy(F.desc("__s"), key).limit(n).drop("__s")


def capped(df: DataFrame, group: str, key: str, most: int = 25, total: int | None = 100_000, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group, and ``total`` in all. The rank is limited map-side, so a large group is not gathered."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    out = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")
    return out.orderBy(F.xxhash64(F.lit(seed + 1), key), key).limit(total) if total else out


def stratified_by_day(df: DataFrame, ts: str, url: str, wanted: int, seed: int = 0) -> DataFrame:
    """Distinct URLs, each day's quota its share of rows (rounded up), a URL's chance by its rows on the day."""
    per = df.groupBy(F.to_date(ts).alias("day"), F.col(url).alias("url")).agg(F.count("*").alias("n"))
    days = per.groupBy("day").agg(F.sum("n").alias("rows"))
    total = days.agg(F.sum("rows").alias("all"))
    quota = days.crossJoin(total).select("day", F.ceil(F.col("rows") * wanted / F.col("all")).alias("quota"))
    w = Window.partitionBy("day").orderBy(F.desc(F.log(unit_hash("day", "url", seed=seed)) / F.col("n")), "url")
    picked = per.withColumn("r", F.row_number().over(w)).join(F.broadcast(quota), "day").filter("r <= quota")
    return picked.groupBy("url").agg(F.min("day").alias("day"))


def path_weight(count: Column, url: Column) -> Column:
    """(1 / count) * 0.707 ** depth of the path."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return F.lit(1.0) / count * F.pow(F.lit(0.707), depth)
