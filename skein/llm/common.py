"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in every contract: space and U+0009 to U+000D. ``bytes.split()`` cuts at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Only a session on one machine (tests) may do without, and gets one; a cluster has to name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """cut() as a Parquet table in the same folder: smaller, and later reads take the columns they need."""
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of names that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in text; null: 0."""
    edge = lambda c: F.when(c.rlike(SPACE), 1).otherwise(0)
    parts = F.size(F.split(text, SPACE)) - edge(F.substring(text, 1, 1)) - edge(F.right(text, F.lit(1)))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(parts).cast("long")


def pylist(column: pa.ChunkedArray | pa.Array) -> list:
    return column.to_pylist()


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, rows: int = 20_000, parts: int | None = None) -> DataFrame:
    """Shuffle df by keys and give fn whole groups, many small ones at a time.

    Groups are bounded by whoever forms them (see ``pair_blocks``); fn gets an Arrow table sorted by keys that never cuts a group and holds about
    ``rows`` rows, or one group where that is larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(table: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
            """fn of whole groups, which end at ends, about ``rows`` rows at a time."""
            at = 0
            for i, end in enumerate(ends):
                if end - at >= rows or i + 1 == len(ends):
                    if (out := fn(table.slice(at, end - at).combine_chunks())) is not None and out.num_rows:
                        yield out
                    at = end

        def borders(table: pa.Table) -> list[int]:
            k = [table.column(c).to_numpy(zero_copy_only=False) for c in keys]
            return (np.flatnonzero(np.logical_or.reduce([a[1:] != a[:-1] for a in k])) + 1).tolist()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            if ends := borders(table):
                yield from flush(table.slice(0, ends[-1]), ends)
                table = table.slice(ends[-1])
            held, n = table.to_batches(), table.num_rows
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from flush(table, [*borders(table), table.num_rows])

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def pair_blocks(df: DataFrame, keys: list[str], by: Column, most: int) -> DataFrame:
    """Add blk_i, blk_j, side so that every two rows of a bucket (equal keys) meet in exactly one block of at most about 2 * most rows.

    A bucket of up to ``most`` rows is one block. A larger one is dealt into chunks by a hash of ``by``, and each pair of chunks is a block; in a
    block with blk_i < blk_j only rows of different sides are to be compared.
    """
    hot = df.groupBy(*keys).count().filter(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    out = df.join(hot, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    out = out.withColumn("mine", F.pmod(F.xxhash64(by, F.lit(17)), F.col("chunks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return out.withColumns({"blk_i": F.least("mine", "other"), "blk_j": F.greatest("mine", "other")}).withColumn("side", (F.col("mine") == F.col("blk_j")).cast("int")).drop("chunks", "mine", "other")


#: Edges of a partition of a graph.
EDGES = 50_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node that has an edge; component is the least node of its part.

    Large-star and small-star in turns (Kiveris et al., Connected Components in MapReduce and Beyond) on DataFrames. Every turn is cut to the shared
    folder; minima are pre-aggregated, and the hub rows of a large star are split by the adaptive skew join. Nulls and loops are left out.
    """
    cur = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    cur = cut(cur)
    seen = mark(cur)
    few = seen["n"] // EDGES + 1  # partitions that hold what there is: small graphs take few files in each shuffle
    for _ in range(rounds):
        if not seen["n"]:
            break
        cur = cur.coalesce(few)
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct().coalesce(few)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = cut(small.coalesce(2 * few).distinct().coalesce(few))
        now = mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    hubs = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(hubs)


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union the pairs (a, b) of 0..n-1: the pairs that joined two trees, and the parents."""
    parent = np.arange(n) if parent is None else parent

    def roots(x: np.ndarray) -> np.ndarray:
        r = parent[x]
        while (up := parent[r]).tobytes() != r.tobytes():
            r = up
        return r

    used_a, used_b = [], []
    while len(a):
        ra, rb = roots(a), roots(b)
        left = ra != rb
        a, b, ra, rb = a[left], b[left], ra[left], rb[left]
        if not len(a):
            break
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        first = np.unique(hi, return_index=True)[1]  # each root hangs under one lower root a turn
        parent[hi[first]] = lo[first]
        used_a.append(a[first])
        used_b.append(b[first])
    none = np.empty(0, np.int64)
    return np.concatenate(used_a or [none]), np.concatenate(used_b or [none]), parent
