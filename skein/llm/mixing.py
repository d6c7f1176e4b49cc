"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix holds as many words as its input. Sources get targets by weight, capped at a number of passes over them. Targets become integer numbers of
equal blocks: every block goes to the highest quotient weight / (2 * blocks so far + 1). A source's blocks are dealt to its shards in the same way by
the shards' sizes; a shard's blocks are then the first of its documents in a seeded order, after as many whole passes as its quota holds.

Cases: null text has size 0 and takes nothing; a null source is a source of its own, after all others; a source of size 0 has target 0; equal rows are
rows of their own; an empty table gives an empty result. Only doc_id, source and text are read. The driver sees one number for each source and
shard; no task holds a source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common

BLOCKS = 1_000_000
MOST_PASSES = 3
#: Rows of a shard, about. The driver plans one number for each shard, 500 for a million rows.
SHARD_ROWS = 2_000
SEED = 42


def targets(sizes: list[int], weights: list[int], passes: int = MOST_PASSES) -> list[float]:
    """Share sum(sizes) by weight; what stands above passes * size is cut there and shared again among the rest."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > passes * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        free -= set(over)
        left = sum(sizes) - sum(out)
    return out


def apportion(weights: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients weight / (2 * seats so far + 1), ties to the first; no more than ``most`` each.

    The seats above a divisor are counted at once, and only the last few are given out one by one.
    """
    w = np.asarray(weights, float)
    most = np.full(len(w), seats) if most is None else np.minimum(np.asarray(most, np.int64), seats)
    most = np.where(w > 0, most, 0)
    seats = min(seats, int(most.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda d: np.minimum(np.ceil(np.maximum(w / max(d, 1e-300) - 1, 0) / 2), most).astype(np.int64)  # noqa: E731  quotients over d
    lo, hi = 0.0, float(w.max()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (lo, mid) if given(mid).sum() <= seats else (mid, hi)
    out = given(hi)
    while int(out.sum()) < seats:
        quotient = np.where(out < most, w / (2 * out + 1), -1)
        out[int(quotient.argmax())] += 1
    return out


def plan(shards: list[tuple[str | None, int, int]], passes: int = MOST_PASSES, blocks: int = BLOCKS) -> list[tuple[str | None, int, int, float, int]]:
    """(source, shard, source_size, target, quota in words) of each (source, shard, size)."""
    sizes: dict[str | None, int] = {}
    parts: dict[str | None, list[tuple[int, int]]] = {}
    for source, shard, n in shards:
        sizes[source] = sizes.get(source, 0) + n
        parts.setdefault(source, []).append((shard, n))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], passes)
    total = sum(sizes.values())
    block = max(1, total // blocks)
    cap = np.array([-(-passes * sizes[s] // block) for s in names])
    seats = dict(zip(names, apportion(np.array(goal), total // block, cap).tolist()))
    out = []
    for k, s in enumerate(names):
        own = sorted(parts[s])
        quota = apportion(np.array([n for _, n in own]), seats[s], np.array([-(-passes * n // block) for _, n in own]))
        out += [(s, shard, sizes[s], goal[k], min(int(q) * block, passes * n)) for (shard, n), q in zip(own, quota)]
    return out


def mix(docs: DataFrame, passes: int = MOST_PASSES, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and text_hash of each row of docs. taken: words the mix takes of it, repeats counted."""
    sized = common.cut(docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    rows = sized.groupBy("source").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    same = lambda a, b: a.eqNullSafe(b)
    sized = sized.join(rows.withColumnRenamed("source", "s"), same(F.col("source"), F.col("s"))).drop("s")
    sized = sized.withColumn("deal", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).withColumn("shard", F.pmod("deal", "shards").cast("int"))
    found = [(r["source"], r["shard"], r["n"]) for r in sized.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()]
    quotas = docs.sparkSession.createDataFrame(plan(found, passes), "s string, k int, source_size long, target double, quota long")
    out = sized.join(quotas, same(F.col("source"), F.col("s")) & (F.col("shard") == F.col("k")))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "deal"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    out = out.withColumn("whole", F.sum("size").over(Window.partitionBy("source", "shard")))
    full = F.when(F.col("whole") > 0, F.expr("quota div whole")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - full * F.col("whole") - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken"), "text_hash")
