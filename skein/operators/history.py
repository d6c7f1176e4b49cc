"""Page histories: first changes, thinning, as-of picks, runs, cumulative states."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_S = 31_556_952  # 365.2425 days
DAY_S = 86_400


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def change_intervals(history: DataFrame, key: str = "url", ts: str = "ts", result: str = "result", parked: str = "is_parked", ok: str = "ok") -> DataFrame:
    """For each key whose first row is ok and not parked: time to the first row that differs from it, or to the last one if none does.

    Two aggregates of structs; the join back to the first row is on the grouping key, so it needs no further shuffle.
    """
    first = history.groupBy(key).agg(F.min_by(F.struct(result, parked, ts), F.struct(ts, result)).alias("f"), F.max(ts).alias("last"))
    first = first.filter((F.col(f"f.{result}") == ok) & ~F.coalesce(F.col(f"f.{parked}"), F.lit(False)))
    rows = history.join(first, key)
    differs = ~(F.col(result).eqNullSafe(F.col(f"f.{result}")) & F.col(parked).eqNullSafe(F.col(f"f.{parked}")))
    hit = rows.filter(differs).groupBy(key).agg(F.min(F.struct(ts, parked, result)).alias("c"))
    out = first.join(hit, key, "left")
    change = F.when(F.col("c").isNull(), "unchanged").when(F.coalesce(F.col(f"c.{parked}"), F.lit(False)), "parked").otherwise(F.col(f"c.{result}"))
    end = F.coalesce(F.col(f"c.{ts}"), F.col("last"))
    return out.select(key, F.col(f"f.{ts}").alias("start"), end.alias("end"), (seconds(end) - seconds(F.col(f"f.{ts}"))).alias("seconds"), change.alias("change"))


def years_since_first(history: DataFrame, key: str, ts: str, status: Column) -> DataFrame:
    first = F.min(ts).over(Window.partitionBy(key))
    return history.select(key, ts, ((seconds(F.col(ts)) - seconds(first)) / YEAR_S).alias("years"), status.alias("status"))


def drop_simultaneous(history: DataFrame, key: str, ts: str) -> DataFrame:
    """Of rows of a key with one time, the first by all columns."""
    return history.withColumn("__r", F.row_number().over(Window.partitionBy(key, ts).orderBy(*history.columns))).filter("__r = 1").drop("__r")


def repeated_keys(history: DataFrame, key: str) -> DataFrame:
    """Rows of keys that have more than one."""
    many = history.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1").select(key)
    return history.join(many, key, "left_semi")


def change_points(rows: DataFrame, key: str, order: str, value: str, newest_first: bool = True) -> DataFrame:
    """Rows whose value differs from that of the row before them."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if newest_first else F.asc(order))
    out = rows.withColumn("prev", F.lag(value).over(w)).withColumn("prev_at", F.lag(order).over(w))
    return out.filter(F.col("prev_at").isNotNull() & ~F.col("prev").eqNullSafe(F.col(value)))


def bisect_changes(known: DataFrame, snaps: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, at: the snapshot to look at next between each two known neighbours whose values differ, the middle one of those between them.

    known: key, at, value of snapshots looked at; snaps: key, at of all. Asked again with each answer added, it ends at the change points: no row is left.
    """
    w = Window.partitionBy(key).orderBy(at)
    gaps = known.select(key, F.col(at).alias("lo"), F.lead(at).over(w).alias("hi"), F.col(value).alias("a"), F.lead(value).over(w).alias("b"))
    gaps = gaps.filter(F.col("hi").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).select(key, "lo", "hi")
    # each snapshot falls into the gap after the last known one: one sort of both, no pairing
    both = snaps.select(key, at, F.lit(None).cast(known.schema[at].dataType).alias("lo"), F.lit(None).cast(known.schema[at].dataType).alias("hi")).unionByName(gaps.select(key, F.col("lo").alias(at), "lo", "hi"))
    before = Window.partitionBy(key).orderBy(at, F.col("lo").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = both.select(key, at, F.col("lo").isNull().alias("snap"), F.last("lo", ignorenulls=True).over(before).alias("lo"), F.last("hi", ignorenulls=True).over(before).alias("hi"))
    inside = own.filter(F.col("snap") & (F.col(at) > F.col("lo")) & (F.col(at) < F.col("hi"))).select(key, at, "lo").distinct()
    gap = Window.partitionBy(key, "lo")
    ranked = inside.withColumn("r", F.row_number().over(gap.orderBy(at))).withColumn("n", F.count("*").over(gap))
    return ranked.filter(F.col("r") == F.ceil(F.col("n") / 2)).select(key, at)


def yearly_picks(snaps: Column, lo: Column, hi: Column) -> Column:
    """Snapshots as of each year back from a week before hi to a year and a week before lo, repeats left out."""
    top, low = hi - F.expr("interval 7 days"), lo - F.expr("interval 372 days")
    marks = F.when(top >= low, F.sequence(top, low, F.expr("interval -365 days -5 hours -49 minutes -12 seconds")))
    picks = F.transform(F.coalesce(marks, F.array()), lambda m: F.array_max(F.filter(snaps, lambda s: s <= m)))
    return F.array_distinct(F.filter(picks, lambda p: p.isNotNull()))


def thin(snaps: Column, lo: Column, hi: Column, gap: str = "30 days") -> Column:
    """Snapshots between lo and hi: the newest at or before lo (else the oldest), then ones at least ``gap`` apart, then the newest before hi."""
    a = F.array_sort(snaps)
    low, high = F.least(lo, hi), F.greatest(lo, hi)
    start = F.coalesce(F.array_max(F.filter(a, lambda x: x <= low)), F.get(a, F.lit(0)))
    mid = F.filter(a, lambda x: (x > start) & (x < high))
    step = F.expr(f"interval {gap}")
    greedy = F.aggregate(mid, F.array(start), lambda acc, x: F.when(x >= F.element_at(acc, -1) + step, F.array_append(acc, x)).otherwise(acc))
    beyond = F.exists(a, lambda x: (x > start) & (x >= high))
    last = F.when(beyond, F.coalesce(F.array_max(mid), start)).otherwise(F.try_element_at(a, F.lit(-1)))
    done = F.when(last > F.element_at(greedy, -1), F.array_append(greedy, last)).otherwise(greedy)
    return F.when(F.size(a) == 0, a).otherwise(done)


def in_range_mark(ts: Column, lo: Column, hi: Column) -> Column:
    """0 before lo, 1 from lo, 2 from hi."""
    return F.when(ts >= hi, 2).when(ts >= lo, 1).otherwise(0)


def ruler_order(n: int) -> list[int]:
    """Positions 0..n-1 in the order of a binary search over all of them: middles first."""
    out, spans = [], [(0, n)]
    for lo, hi in spans:
        if lo < hi:
            mid = (lo + hi) // 2
            out.append(mid)
            spans += [(lo, mid), (mid + 1, hi)]
    return out


def topic_runs(rows: DataFrame, key: str, order: str, text: str, same: Callable[[str, str], bool] | None = None) -> DataFrame:
    """Topic labels of each key's rows, newest first: a row takes the label of the first newer text that is on the same topic, or a new one."""
    same = same or same_topic

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=False, kind="stable")
        known: list[str] = []
        labels = []
        for t in pdf[text].fillna(""):
            for i, k in enumerate(known):
                if same(k, t):
                    labels.append(i)
                    break
            else:
                labels.append(len(known))
                known.append(t)
        return pdf.assign(topic=labels)[[key, order, "topic"]]

    dt = dict(rows.dtypes)
    return rows.select(key, order, text).groupBy(key).applyInPandas(label, f"{key} {dt[key]}, {order} {dt[order]}, topic int")


def same_topic(a: str, b: str, least: float = 0.5) -> bool:
    """Equal texts are one topic, an empty one (nothing after the languages) is on none; else by shared words."""
    if a == b:
        return True
    if not a or not b or a.endswith(",") or b.endswith(","):
        return False
    x, y = (set(t.rpartition(",")[2].split()) for t in (a, b))
    return bool(x and y) and len(x & y) / (len(x) * len(y)) ** 0.5 >= least


def topic_string(labels: Sequence[int | None]) -> str:
    """One sign for each label: a dot where there is none, else base 62, a caret beyond."""
    signs = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return "".join("." if x is None else signs[x] if x < 62 else "^" for x in labels)


def squeeze(arr: Column) -> Column:
    """Without consecutive repeats, reversed."""
    return F.reverse(F.filter(arr, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(arr, i - 1))))


def area_bins(changes: DataFrame, what: str = "what", secs: str = "seconds") -> DataFrame:
    """Cumulative numbers of changes by day for each kind, and what is still original, on a full grid of days."""
    day = F.greatest(F.ceil(F.col(secs) / DAY_S), F.lit(0)).cast("int")
    binned = changes.groupBy(day.alias("day"), F.col(what).alias("what")).agg(F.count("*").alias("k"))
    kinds = binned.select("what").distinct()
    days = binned.agg(F.max("day").alias("m")).filter("m is not null").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("day"))
    grid = days.crossJoin(F.broadcast(kinds))  # kinds of change: a fixed short list
    run = Window.partitionBy("what").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cum = grid.join(binned, ["day", "what"], "left").withColumn("n", F.sum(F.coalesce("k", F.lit(0))).over(run)).select("day", "what", "n")
    total = changes.agg(F.count("*").alias("t"))
    rest = cum.groupBy("day").agg(F.sum("n").alias("n")).crossJoin(total).select("day", F.lit("original").alias("what"), (F.col("t") - F.col("n")).alias("n"))
    return cum.unionByName(rest)


def ewma(rows: DataFrame, key: str, order: str, value: str, alpha: float = 2 / 11) -> DataFrame:
    """Exponentially weighted average over each key's rows in order; one key's values are folded in an array."""
    vals = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double"))
    per = rows.groupBy(key).agg(vals.alias("v"))
    fold = F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), F.get("v", F.lit(0)), lambda acc, x: acc + F.lit(alpha) * (x - acc))
    return per.select(key, fold.alias("ewma"))


def session_pairs(rows: DataFrame, key: str, order: str, what: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Rows (key, start, stop) of start events that the next event of their key stops."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn("next_what", F.lead(what).over(w)).withColumn("next_at", F.lead(order).over(w))
    return out.filter((F.col(what) == start) & (F.col("next_what") == stop)).select(key, F.col(order).alias("start"), F.col("next_at").alias("stop"))


def transition_counts(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """How often each state follows each other: what a multi-state Markov model is fitted on, with crude rates per second."""
    w = Window.partitionBy(key).orderBy(order)
    steps = rows.withColumn("to", F.lead(state).over(w)).withColumn("dt", seconds(F.lead(order).over(w)) - seconds(F.col(order))).filter("to is not null")
    n = steps.groupBy(F.col(state).alias("from"), "to").agg(F.count("*").alias("n"))
    held = steps.groupBy(F.col(state).alias("from")).agg(F.sum("dt").alias("held_s"))
    return n.join(held, "from").withColumn("rate", F.when(F.col("held_s") > 0, F.col("n") / F.col("held_s")))
