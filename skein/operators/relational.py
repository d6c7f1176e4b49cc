"""Relational shapes that are not one built-in call: interning, upserts, deltas, renumbering, range and as-of joins, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by order. As one aggregate of a struct: pre-aggregated, no sort of whole groups."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_cols)])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_on(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def intern(new: DataFrame, key: str, id_col: str = "id", existing: DataFrame | None = None) -> DataFrame:
    """Ids for keys: those that exist keep theirs, new ones follow from the highest, in key order.

    Numbers come from a range-partitioned sort and the counts before each partition, not from one task.
    """
    fresh = new.select(key).where(F.col(key).isNotNull()).distinct()
    base = 0
    if existing is not None:
        fresh = fresh.join(existing, key, "left_anti")
        base = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    numbered = row_numbers(fresh, [key], id_col).withColumn(id_col, F.col(id_col) + base)
    return numbered if existing is None else existing.select(key, id_col).unionByName(numbered.select(key, id_col))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "n", start: int = 1) -> DataFrame:
    """Consecutive numbers in global order without gathering rows: ranges are numbered apart and shifted by the rows before them.

    Ranges come from a sample that Spark draws anew for each plan, so their least keys and counts are taken once and rows find their range by its least key.
    """
    key = F.struct(*order)
    ranges = df.select(*order).repartitionByRange(*[F.col(c) for c in order]).groupBy(F.spark_partition_id()).agg(F.min(key).alias("k"), F.count("*").alias("c"))
    ranges = ranges.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("r"))  # an entry for each range
    before = lambda i: F.aggregate(F.slice("r.c", 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    ranges = ranges.select(F.col("r.k").alias("__least"), F.transform("r", lambda x, i: before(i)).alias("__before"))
    at = lambda p: F.when((p <= F.size("__least")) & (F.get("__least", p - 1) <= key), p)
    found = F.aggregate(F.array(*[F.lit(2**i) for i in reversed(range(20))]), F.lit(0), lambda p, step: F.coalesce(at(p + step), p))
    parts = df.crossJoin(F.broadcast(ranges)).withColumn("__p", found)
    parts = parts.withColumn("__b", F.get("__before", F.col("__p") - 1)).drop("__least", "__before")
    return parts.withColumn(name, F.row_number().over(Window.partitionBy("__p").orderBy(*order)) + F.col("__b") + F.lit(start - 1)).drop("__p", "__b")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new replace those of old with equal keys; the others stay or are added."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*values).alias("__n"))
    o = old.select(*keys, F.struct(*values).alias("__o"))
    both = o.join(n, list(keys), "full_outer")
    row = F.coalesce("__n", "__o")
    return both.select(*keys, *[row[v].alias(v) for v in values]).select(*old.columns)


def seed_missing(old: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with a row of nulls for each key that it lacks."""
    missing = keys_df.select(*keys).distinct().join(old, list(keys), "left_anti")
    return old.unionByName(missing, allowMissingColumns=True)


def strict_update(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """upsert() that fails, while it runs, if new has a key that old lacks."""
    marked = new.join(old.select(*keys, F.lit(True).alias("__known")), list(keys), "left")
    checked = marked.withColumn("__ok", F.when(F.col("__known"), True).otherwise(F.raise_error(F.lit("update of a missing row")).cast("boolean")))
    return upsert(old, checked.filter("__ok").drop("__known", "__ok"), keys)


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and the rows of new whose key is not in it yet, one for each key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti").select(*old.columns))


def update_from(target: DataFrame, source: DataFrame, on: Sequence[str], sets: dict[str, str]) -> DataFrame:
    """UPDATE ... FROM: columns of target take source's values where a row matches and has one."""
    own = source.select(*on, *[F.col(v).alias(f"__{k}") for k, v in sets.items()])
    out = target.join(own, list(on), "left")
    return out.withColumns({k: F.coalesce(F.col(f"__{k}"), F.col(k)) for k in sets}).select(*target.columns)


def delta(source: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that were not copied yet."""
    return source.join(done.select(*keys), list(keys), "left_anti")


def renumber_first_seen(tables: Sequence[DataFrame], key: str, name: str = "new_id") -> DataFrame:
    """New ids for keys of several tables: by the first table that has the key, then by key."""
    seen = None
    for i, t in enumerate(tables):
        own = t.select(F.lit(i).alias("ord"), key)
        seen = own if seen is None else seen.unionByName(own)
    first = seen.groupBy(key).agg(F.min("ord").alias("ord"))
    return row_numbers(first, ["ord", key], name).drop("ord")


def inconsistent(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Fine values that stand under more than one coarse value."""
    return df.groupBy(fine).agg(F.count_distinct(coarse).alias("n")).filter("n > 1")


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int, how: str = "inner") -> DataFrame:
    """points with lo <= at < hi: ranges are posted under each bin they touch, so it runs as a hash or merge join on the bin."""
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    own = points.withColumn("__bin", F.floor(F.col(at) / width))
    out = own.join(binned, (own["__bin"] == binned["__bin"]) & (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)), how)
    return out.drop("__bin")


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """The value of right's last row at or before each row of left: one sort of both, no pairing."""
    l = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__left": F.lit(1)})
    r = right.select(*by, at, F.col(value).alias("__v"), F.lit(0).alias("__left"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__left = 1").drop("__v", "__left")


def or_join(left: DataFrame, right: DataFrame, column: str, candidates: Sequence[str]) -> DataFrame:
    """LEFT JOIN ON left.column = c1 OR left.column = c2: candidates are exploded to one key, which keeps it an equi-join."""
    keys = right.withColumn("__k", F.explode(F.array_distinct(F.array(*candidates)))).filter("__k is not null")
    return left.join(keys, left[column] == keys["__k"], "left").drop("__k")


def isolate(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Good and bad rows apart, so that a bad row stops no batch."""
    flagged = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    return flagged.filter("__ok").drop("__ok"), flagged.filter(~F.col("__ok")).drop("__ok")


def assert_empty(df: DataFrame, message: str) -> None:
    if df.limit(1).count():
        raise ValueError(message)


def zero_filled_days(df: DataFrame, ts: str) -> DataFrame:
    """Rows of each day between the first and the last, days without any as 0."""
    day = F.to_date(ts)
    counts = df.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bad_to_good(urls: DataFrame, canon: Column, id_col: str = "id", url: str = "url") -> DataFrame:
    """URLs stored in another than their canonical form, with the stored canonical twin if there is one."""
    own = urls.select(F.col(id_col).alias("bad_id"), F.col(url).alias("bad_url"), canon.alias("good_url")).filter("good_url is null or good_url <> bad_url")
    good = urls.select(F.col(id_col).alias("good_id"), F.col(url).alias("good_url"))
    return own.join(good, "good_url", "left").select("bad_id", "good_id", "bad_url", "good_url")


def any_of(cases: Sequence[dict[str, object]]) -> Column:
    """Rows that equal one of the cases in all columns it names: a disjunction of conjunctions. No case: no row; a case without columns: all."""
    none = F.lit(False)
    for case in cases:
        every = F.lit(True)
        for name, value in case.items():
            every &= F.col(name).eqNullSafe(F.lit(value))
        none |= every
    return none


def default_from(df: DataFrame, column: str, one: DataFrame, value: str) -> DataFrame:
    """df with nulls of a column filled by the value of the only row of ``one``; null where that has no row, an error where it has more."""
    only = one.agg(F.when(F.count("*") > 1, F.raise_error(F.lit("more than one row for a default")).cast(df.schema[column].dataType)).otherwise(F.max(value)).alias("__default"))
    return df.crossJoin(F.broadcast(only)).withColumn(column, F.coalesce(column, "__default")).drop("__default")  # one row


def derived_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: Column, right_on: Column) -> DataFrame:
    """Join on equal keys and equal values computed on each side, such as the earlier of two dates. Nulls do not meet."""
    return left.withColumn("__on", left_on).join(right.withColumn("__on", right_on), [*keys, "__on"]).drop("__on")
