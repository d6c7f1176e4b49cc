"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned (Gong & Lazebnik, iterative quantisation) from a bounded sample: vectors are centred, turned to their principal axes, and the
rotation that brings them nearest to the corners of the cube is found by turns of signs and orthogonal Procrustes. A vector's signs are its binary code.
Codes are cut into substrings of equal width, each the key of a table; vectors that share a key in any table are compared by their original values in
double precision. The width follows the number of vectors (buckets of about BUCKET vectors), and as many tables are made, from several rotations,
as bring the chance that a pair at the threshold shares none of them under MISS. Centring widens the angle of near vectors where all have a direction in common;
so sampled vectors are moved to the threshold, the share of them that meets in no table is measured, and tables of codes without centring, which agree by the angle alone, are
added until it is under MISS as well.

Equal vectors are one entry with a count, so copies are never paired. A bucket of any size is dealt into blocks of bounded size (``pair_blocks``); a
block gives each vector's count of partners and only the links that connect it, and a pair that shares several tables counts in the first one.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing and are their own
component; vectors of different lengths are never compared; a null vec_id is a row of its own without component; repeated rows are copies of each
other; an empty table gives an empty result; only vec_id, embedding and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common, vectors

THRESHOLD = 0.93
SAMPLE, TURNS = 10_000, 30
BUCKET, MISS = 64, 0.001
BLOCK_ROWS = 4_096


def rotation(x: np.ndarray, seed: int, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are balanced codes of the sample x."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    dim = x.shape[1]
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean) + 1e-9 * np.eye(dim))
    v = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    for _ in range(turns if len(x) > dim else 0):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
        r = u @ w
    return mean, axes @ r


def layout(n: int, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """(bits of a substring, number of tables) for n vectors."""
    width = int(min(24, max(8, math.ceil(math.log2(max(1, n / bucket))))))
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log(1 - same))


def moved(unit: np.ndarray, threshold: float, seed: int = 9) -> np.ndarray:
    """A vector of cosine ``threshold`` to each of the unit vectors."""
    side = np.random.default_rng(seed).standard_normal(unit.shape)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    side /= np.maximum(np.sqrt((side * side).sum(axis=1, keepdims=True)), 1e-12)
    return threshold * unit + math.sqrt(1 - threshold * threshold) * side


class Tables:
    def __init__(self, sample: np.ndarray, width: int, tables: int, threshold: float = THRESHOLD, miss: float = MISS):
        self.dim = sample.shape[1]
        self.width, self.tables = min(width, self.dim), tables
        self.each = self.dim // self.width
        self.models = [rotation(sample, seed) for seed in range(-(-tables // self.each))]
        near = moved(sample, threshold)
        apart = ~(self.keys(sample) == self.keys(near)).any(axis=1)
        while self.dim > 1 and apart.sum() > miss * len(sample):  # only the pairs that are still missed are coded again
            turn = np.linalg.qr(np.random.default_rng(1000 + len(self.models)).standard_normal((self.dim, self.dim)))[0]
            more = (np.zeros(self.dim), turn)
            self.tables = len(self.models) * self.each + self.each
            self.models.append(more)
            apart[apart] = ~(self.coded(sample[apart], more) == self.coded(near[apart], more)).any(axis=1)

    def coded(self, unit: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        mean, turn = model
        bits = (unit - mean) @ turn >= 0
        return np.stack([bits[:, k * self.width : (k + 1) * self.width] @ (1 << np.arange(self.width)) for k in range(self.each)], axis=1)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A row of table keys for each unit vector."""
        out = [self.coded(unit, m) for m in self.models]
        return np.concatenate(out, axis=1)[:, : self.tables].astype(np.int32) if out else np.zeros((len(unit), 0), np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(table: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Of blocks: (rep, partners, null) counts of weights, and (a, null, b) links that connect."""
    keys = {c: table.column(c).to_numpy() for c in ("label", "dim", "t", "key", "blk_i", "blk_j")}
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys.values()])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], table.num_rows)
    busy = end - begin > 1
    if not busy.any():
        return None
    rep, side, weight = (table.column(c).to_numpy() for c in ("rep", "side", "n"))
    x, code = unit(vectors.matrix(table.column("embedding"))), vectors.matrix(table.column("codes")).astype(np.int32)
    out_rep, out_n, out_a, out_b = [], [], [], []
    for b, e in zip(begin[busy].tolist(), end[busy].tolist()):
        t, apart = int(keys["t"][b]), keys["blk_i"][b] != keys["blk_j"][b]
        count = np.zeros(e - b, np.int64)
        parent = None
        for i in range(b, e, 512):
            j = min(e, i + 512)
            near = x[i:j] @ x[i:e].T >= threshold
            p, q = np.nonzero(near)
            p, q = p + i, q + i
            good = p < q
            if apart:
                good &= side[p] != side[q]
            p, q = p[good], q[good]
            if t and len(p):
                for k in range(0, len(p), 1_000_000):  # a pair counts in the first table it shares
                    s = slice(k, k + 1_000_000)
                    first = ~(code[p[s], :t] == code[q[s], :t]).any(axis=1)
                    p[s], q[s] = np.where(first, p[s], -1), np.where(first, q[s], -1)
                p, q = p[p >= 0], q[q >= 0]
            if len(p):
                np.add.at(count, p - b, weight[q])
                np.add.at(count, q - b, weight[p])
                la, lb, parent = common.forest(e - b, p - b, q - b, parent)
                out_a.append(rep[la + b])
                out_b.append(rep[lb + b])
        some = count > 0
        out_rep.append(rep[b:e][some])
        out_n.append(count[some])
    r, n = np.concatenate(out_rep), np.concatenate(out_n)
    a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (out_a, out_b))
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.record_batch([pa.concat_arrays([pa.array(r), pa.array(a)]), pa.concat_arrays([pa.array(n), none(len(a))]), pa.concat_arrays([none(len(r)), pa.array(b)])], ["a", "n", "b"])


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of df (vec_id, embedding, label)."""
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = vectors.usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumns({"h1": F.when(good, F.xxhash64("label", "embedding")), "h2": F.when(good, F.xxhash64(F.lit(11), "embedding", "label"))})
    entries = rows.filter(good).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    entries = common.cut(entries.withColumn("dim", F.size("embedding")))
    most = entries.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most")).orderBy(F.desc("most"), "dim").collect()  # one row for each length
    models = {}
    for row in most:
        models[row["dim"]] = Tables(unit(vectors.sample(entries.filter(F.col("dim") == row["dim"]), SAMPLE)), *layout(row["most"], threshold), threshold)
    shared = spark.sparkContext.broadcast(models)  # dim * dim doubles for each rotation

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                keys = shared.value[int(d)].keys(unit(vectors.matrix(own.column("embedding"))))
                yield pa.record_batch([*own.columns, pa.array(list(keys), pa.list_(pa.int32()))], [*own.schema.names, "codes"])

    coded = entries.select("rep", "n", "label", "dim", "embedding").mapInArrow(code, "rep long, n long, label long, dim int, embedding array<float>, codes array<int>")
    posts = coded.select("*", F.posexplode("codes").alias("t", "key"))
    blocks = common.pair_blocks(posts, ["label", "dim", "t", "key"], F.col("rep"), block_rows)
    found = common.cut(common.by_group(blocks, ["label", "dim", "t", "key", "blk_i", "blk_j"], lambda t: compare(t, threshold), "a long, n long, b long", rows=20_000))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("partners"))
    parts = common.components(found.filter("b is not null").select("a", "b"))
    own = entries.select("h1", "h2", "rep", "n").join(counts, F.col("rep") == F.col("a"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    own = own.select("h1", "h2", (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(own, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
