"""Hop graphs: topological order, simple paths, common prefixes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topo_levels(edges: pd.DataFrame) -> list[list[str]]:
    """Nodes without open predecessors, level by level, each in alphabetical order; what stands on a cycle comes last."""
    nodes = set(edges.src) | set(edges.dst)
    before = {n: set() for n in nodes}
    for a, b in zip(edges.src, edges.dst):
        if a != b:
            before[b].add(a)
    out: list[list[str]] = []
    while before:
        free = sorted(n for n, p in before.items() if not p) or [min(before)]
        out.append(free)
        for n in free:
            before.pop(n)
        for p in before.values():
            p.difference_update(free)
    return out


def topo_sort(edges: DataFrame, trace: str = "trace") -> DataFrame:
    """(trace, pos, level, node) of each trace; a trace is the few hops between two hosts."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf[trace].iloc[0], lvl, n) for lvl, own in enumerate(topo_levels(pdf)) for n in own]
        return pd.DataFrame([(t, i, lvl, n) for i, (t, lvl, n) in enumerate(rows)], columns=[trace, "pos", "level", "node"])

    return edges.groupBy(trace).applyInPandas(one, f"{trace} {dict(edges.dtypes)[trace]}, pos int, level int, node string")


def paths(edges: DataFrame, source: str) -> DataFrame:
    """All simple paths from the source to nodes without a way on, by one join for each hop until none goes on."""
    step = edges.select(F.col("src").alias("__s"), "dst").distinct()
    cur = edges.sparkSession.createDataFrame([([source],)], "path array<string>")
    done = None
    while True:
        nxt = cur.join(step, F.element_at("path", -1) == F.col("__s"), "left").withColumn("go", F.col("dst").isNotNull() & ~F.array_contains("path", F.coalesce("dst", F.lit(""))))
        moved = nxt.filter("go").select(F.array_append("path", F.col("dst")).alias("path")).distinct()
        ended = cur.join(moved.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct(), "path", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        cur = moved
        if cur.isEmpty():
            return done


def common_prefixes(traces: DataFrame, key: str, hops: str) -> DataFrame:
    """The longest common prefixes of traces that are neighbours when sorted within their key."""
    w = Window.partitionBy(key).orderBy(F.array_join(hops, "\x01", "\x02"))
    both = traces.withColumn("nxt", F.lead(hops).over(w)).filter("nxt is not null")
    n = F.least(F.size(hops), F.size("nxt"))
    same = F.transform(F.sequence(F.lit(0), n), lambda i: (i < n) & F.get(F.col(hops), i).eqNullSafe(F.get(F.col("nxt"), i)))
    length = F.array_position(same, False) - 1
    return both.select(key, F.slice(hops, F.lit(1), length.cast("int")).alias("prefix")).filter(F.size("prefix") > 0).distinct()
