"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample: each node's vectors are split by k-means into BRANCHES until LEAF are left. Every row goes down to the leaf of
the nearest centres. A query walks the tree with a priority queue of branches by distance and visits leaves, nearest first (Muja & Lowe), until it has
visited as many as calibration asks for and they hold enough rows. Calibration widens the visits until sampled queries, run against the sample by brute
force, find RECALL of their true neighbours. Rows of visited leaves are compared by their original values.

Leaves are dealt into blocks of bounded size, with the queries that visit a leaf in each of its blocks; a block hands on the best k of each query.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, take no part; a query whose vec_id occurs twice
is asked once, with the vector that sorts first; vectors of another length than the commonest one are compared exactly, with those of their
length only; fewer candidates than k give fewer rows; equal scores go to the smaller vec_id; an empty table gives an empty result; only vec_id and
embedding are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common, vectors

K = 10
SAMPLE, BRANCHES, LEAF, TURNS = 20_000, 8, 128, 8
RECALL, ASKED = 0.98, 400
BLOCK_ROWS = 8_192


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0)


class Tree:
    """Nodes by number: centre, children; leaves have none."""

    def __init__(self, x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 5):
        self.dim = x.shape[1]
        self.centres, self.children, self.leaves = [x.mean(axis=0)], [[]], 0
        rng = np.random.default_rng(seed)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf:
                continue
            c = x[rng.choice(own, branches, replace=False)]
            for _ in range(TURNS):
                near = squared(x[own], c).argmin(axis=1)
                for k in range(branches):
                    if (near == k).any():
                        c[k] = x[own[near == k]].mean(axis=0)
            near = squared(x[own], c).argmin(axis=1)
            parts = [own[near == k] for k in range(branches)]
            if max(map(len, parts)) == len(own):  # equal vectors
                continue
            for k in range(branches):
                self.centres.append(c[k])
                self.children.append([])
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, parts[k]))
        self.centres = np.array(self.centres)
        self.leaves = sum(not c for c in self.children)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        open_rows = np.arange(len(x))
        while len(open_rows):
            for node in np.unique(at[open_rows]):
                own = open_rows[at[open_rows] == node]
                if kids := self.children[node]:
                    at[own] = np.array(kids)[squared(x[own], self.centres[kids]).argmin(axis=1)]
            open_rows = open_rows[[bool(self.children[n]) for n in at[open_rows]]]
        return at

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not (kids := self.children[node]):
                yield node
                continue
            d = self.centres[kids] - q
            for kid, dist in zip(kids, (d * d).sum(axis=1).tolist()):
                heapq.heappush(queue, (dist, kid))

    def calibrate(self, x: np.ndarray, k: int, recall: float = RECALL, asked: int = ASKED) -> int:
        """Leaves to visit so that the sample's own queries find that share of their true neighbours."""
        n = min(asked, len(x))
        q = np.linspace(0, len(x) - 1, n).astype(int) if n else np.empty(0, int)
        leaf, ranks = self.place(x), []
        for i in q:
            d = squared(x[i : i + 1], x)[0]
            d[i] = np.inf
            true = np.argpartition(d, min(k, len(x) - 1))[: min(k, len(x) - 1)]
            order = {node: r for r, node in enumerate(self.walk(x[i]))}
            ranks += [order[m] for m in leaf[true]]
        if not ranks:
            return self.leaves
        return int(np.quantile(ranks, recall, method="higher")) + 1


def compare(table: pa.Table, k: int) -> pa.RecordBatch | None:
    """The best k rows of each query in each block."""
    leaf, block, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "block", "asks"))
    ids, queries = table.column("vec_id").to_numpy(), table.column("query_id").to_numpy(zero_copy_only=False)
    x = vectors.matrix(table.column("embedding"))
    begin = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]))))
    out_q, out_v, out_d = [], [], []
    for b, e in zip(begin.tolist(), np.append(begin[1:], len(leaf)).tolist()):
        own = np.arange(b, e)
        q, r = own[asks[b:e]], own[~asks[b:e]]
        if not len(r):
            continue
        r = r[np.argsort(ids[r], kind="stable")]
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            rough = squared(x[part], x[r])
            rough[ids[part][:, None] == ids[r][None]] = np.inf
            m = min(len(r), k + 1)
            bar = np.partition(rough, m - 1, axis=1)[:, m - 1] if m else None
            for row, at, top in zip(rough, part, bar):
                near = np.flatnonzero(row <= top * (1 + 1e-9) + 1e-12)  # ties at the border stay in
                near = near[np.isfinite(row[near])]
                d = np.sqrt(((x[r[near]] - x[at]) ** 2).sum(axis=1))
                best = np.lexsort((ids[r[near]], d))[:k]
                out_q.append(np.full(len(best), ids[at]))
                out_v.append(ids[r[near[best]]])
                out_d.append(d[best])
    if not out_q:
        return None
    return pa.record_batch([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_d)], ["query_id", "vec_id", "score"])


def nearest(df: DataFrame, asked: Column, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of df (vec_id, embedding) found nearest to each row for which ``asked`` holds, itself left out."""
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(vectors.usable() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("dim", F.size("embedding"))
    common_dim = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    x = vectors.sample(rows.filter(F.col("dim") == (common_dim["dim"] if common_dim else 0)), SAMPLE)
    tree = Tree(x) if len(x) else None
    visits = tree.calibrate(x, k) if tree else 0
    shared = spark.sparkContext.broadcast(tree)  # at most about SAMPLE / LEAF * BRANCHES centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            leaf = -dims.astype(np.int64)
            if (own := dims == shared.value.dim).any():
                leaf[own] = shared.value.place(vectors.matrix(batch.filter(pa.array(own)).column("embedding")))
            yield pa.record_batch([batch.column("vec_id"), batch.column("embedding"), batch.column("dim"), pa.array(leaf.astype(np.int32))], ["vec_id", "embedding", "dim", "leaf"])

    placed = common.cut(rows.mapInArrow(place, "vec_id long, embedding array<float>, dim int, leaf int"))
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf
    counts = spark.sparkContext.broadcast(held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts_by_leaf = shared.value, counts.value
        for batch in batches:
            at, leaves = [], []
            for i, (leaf, v) in enumerate(zip(batch.column("leaf").to_pylist(), batch.column("embedding"))):
                if leaf < 0:
                    at.append(i)
                    leaves.append(leaf)
                    continue
                seen = rows_seen = 0
                for node in tree.walk(np.array(v.values.to_numpy(), float)):
                    if seen >= visits and rows_seen > k:
                        break
                    seen += 1
                    if n := counts_by_leaf.get(node, 0):
                        rows_seen += n
                        at.append(i)
                        leaves.append(node)
            own = pa.array(at, pa.int32())
            yield pa.record_batch([batch.column("vec_id").take(own), batch.column("embedding").take(own), pa.array(leaves, pa.int32())], ["vec_id", "embedding", "leaf"])

    queries = placed.filter(asked).groupBy("vec_id").agg(F.min(F.struct("embedding", "leaf")).alias("q")).select("vec_id", "q.embedding", "q.leaf")
    routed = queries.repartition("vec_id").mapInArrow(route, "vec_id long, embedding array<float>, leaf int")
    blocks = spark.createDataFrame([(leaf, -(-n // block_rows)) for leaf, n in sorted(held.items())] or [(0, 1)], "leaf int, blocks int")
    salt = F.pmod(F.xxhash64("vec_id", F.lit(23)), "blocks").cast("int")
    mine = placed.join(blocks, "leaf").select("leaf", salt.alias("block"), F.lit(False).alias("asks"), "vec_id", F.lit(-1).cast("long").alias("query_id"), "embedding")
    theirs = routed.join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "vec_id", F.col("vec_id").alias("query_id"), "embedding")
    found = common.by_group(mine.union(theirs), ["leaf", "block"], lambda t: compare(t, k), "query_id long, vec_id long, score double", rows=20_000)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
