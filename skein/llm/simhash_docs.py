"""SimHash near-duplicates of documents by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 bytes, so they share at least 4 of their 8 positional bytes. The index posts
each distinct fingerprint under sets of three positional bytes, chosen so that any four positions hold one of the sets whole (a Turan (8,4,3) system of
20 sets): every pair that can qualify meets in a posting list, and lists stay 2**16 times shorter than those of single bytes. In a list the shared
positional bytes of each pair are tallied, pairs under the guaranteed minimum are dropped, the rest verified by their differing bits.

Cases: null or empty text has no words and fingerprint zero; texts of fewer than four words have one shingle; equal fingerprints (exact copies) are
one index entry however many rows share them; a null doc_id gets a fingerprint and a null component; repeated rows stay repeated; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

SHINGLE, SEED, MOST_BITS = 4, 42, 4
BYTES = 8
LIST_ROWS = 8_192


def key_sets() -> list[tuple[int, ...]]:
    """Sets of three of 8 positions such that any four positions hold one: three groups, all of one group or two of it and one of the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def fits(s: tuple[int, ...]) -> bool:
        g = sorted(group[i] for i in s)
        return g[0] == g[2] or any(g.count(k) == 2 and g.count((k + 1) % 3) == 1 for k in range(3))

    return [s for s in combinations(range(BYTES), 3) if fits(s)]


def fingerprint(text: bytes | None) -> int:
    """64 bits: a bit is 1 if over half the shingles' XXH64 have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return majority(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())), np.uint64, len(words) - SHINGLE + 1))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(table: pa.Table) -> pa.RecordBatch | None:
    """Edges that join what a run of posting lists links: (a, b) of entries, only as many as it takes to connect them."""
    cols = {c: table.column(c).to_numpy() for c in ("k", "key", "blk_i", "blk_j", "side", "fp", "rep")}
    fp = cols["fp"].view(np.uint64)
    new = np.ones(len(fp), bool)
    new[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in ("k", "key", "blk_i", "blk_j")])
    begin = np.flatnonzero(new)
    end = np.repeat(np.append(begin[1:], len(fp)), np.diff(np.append(begin, len(fp))))
    apart = cols["blk_i"] != cols["blk_j"]
    parent, found_a, found_b = None, [], []
    ids, at = np.unique(cols["rep"], return_inverse=True)
    pos = np.arange(len(fp))
    step = 1
    while len(pos := pos[pos + step < end[pos]]):
        other = pos + step
        x = fp[pos] ^ fp[other]
        shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)  # the pair's tally of positional bytes
        near = (shared >= BYTES - MOST_BITS) & (np.bitwise_count(x) <= MOST_BITS) & (~apart[pos] | (cols["side"][pos] != cols["side"][other]))
        if near.any():
            a, b, parent = common.forest(len(ids), at[pos[near]], at[other[near]], parent)
            found_a.append(ids[a])
            found_b.append(ids[b])
        step += 1
    return pa.record_batch([np.concatenate(found_a), np.concatenate(found_b)], ["a", "b"]) if found_a else None


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id, n_copies (rows with the same fingerprint) of each row of docs."""
    fps = common.cut(fingerprints(docs))
    entries = fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    posts = F.array(*[F.struct(F.lit(k).alias("k"), (byte(a) * 65536 + byte(b) * 256 + byte(c)).cast("int").alias("key")) for k, (a, b, c) in enumerate(key_sets())])
    index = entries.select("fp", "rep", F.explode(posts).alias("p")).select("p.k", "p.key", "fp", "rep")
    blocks = common.pair_blocks(index, ["k", "key"], F.col("rep"), LIST_ROWS)
    edges = common.by_group(blocks, ["k", "key", "blk_i", "blk_j"], links, "a long, b long", rows=200_000)
    parts = common.components(edges)
    groups = entries.join(parts, entries.rep == parts.node, "left").select("fp", "n_copies", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(groups, "fp", "left")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
