"""Substring dedup of long word sequences by prefix-partitioned suffix trees.

A suffix here starts a window of WINDOW words. Suffixes whose window cannot repeat are dropped first: every window is named by its anchor, the least
hash among its GRAM-word sequences; equal windows have equal anchors, so only anchors that occur in two documents matter (about one anchor for 22
words is counted, pre-aggregated, not one for each word). Equal texts are one entry, so no number of copies makes a key hot. The suffixes left are split by that prefix key, and by a salt where one key would not fit in
memory, into groups of bounded size. A task builds the suffix tree of its group down to depth WINDOW by naming ever longer prefixes (1, 2, 4, ... words;
two suffixes have one name at a depth exactly if they share a node there). Nodes at full depth are the repeats: each holds the least doc_id of its
suffixes, and every suffix of a larger document is a repeat. A salted key's groups hand on the suffixes of the least doc_id of each of their nodes at full depth (more
than one where that document repeats itself), keyed by the whole window (the longest prefix that matters); the least doc_id of each is then found over all
groups.

Cases: null text has no words; null doc_id neither repeats nor is repeated; rows that share a doc_id are never repeats of each other; documents
under WINDOW words lose nothing; equal rows are judged alike; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

WINDOW, GRAM = 50, 8
#: Occurrences of one prefix key in a group (each has at most about 2 * WINDOW words), and words in one tree.
GROUP_ROWS, TREE_ROWS = 1_000, 3_000
CHUNK_BYTES = 500_000
#: End of a run that takes in all words.
ALL = 2**31 - 1

_rng = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = (np.uint64(x | 1) for x in _rng.integers(2**62, 2**63, 2, dtype=np.uint64).tolist())
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them; kept for the next call."""
    if (got := _TABLES.get(int(base))) is None or len(got) < n:
        got = _TABLES[int(base)] = _powers(base, max(n, 2**16))
    return got


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    gap = np.concatenate(([True], _SPACES[data], [True]))
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * powers(_BASE, len(data))[: len(data)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * powers(inverse(_BASE), len(data) + 1)[starts]
    return mixed(own + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_STEP, len(hashes))[: len(hashes)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(inverse(_STEP), len(hashes) + 1)[: len(hashes) - n + 1])


def anchors(grams: np.ndarray, n: int) -> np.ndarray:
    """Least of each n grams in turn."""
    if len(grams) < n:
        return np.empty(0, np.uint64)
    out, span = grams, 1
    while 2 * span <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(grams) - n + 1], out[n - span :])


def distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of columns, sorted."""
    order = np.lexsort(columns[::-1])
    own = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in own])
    return [c[new] for c in own]


class Text:
    """Words, hashes and window anchors of a run of documents; windows that cross a border are not whole."""

    def __init__(self, texts: list[bytes], window: int):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.starts, self.ends = words(self.data)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, offsets)  # first word of each document
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        gram = min(GRAM, window)
        grams = gram_hashes(word_hashes(self.data, self.starts, self.ends), gram)
        self.anchor = anchors(grams, window - gram + 1)
        n = len(self.anchor)
        self.whole = self.doc[:n] == self.doc[window - 1 : window - 1 + n] if n else np.empty(0, bool)


def runs(batches: Iterator[pa.RecordBatch], column: int, unpack: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches that hold about CHUNK_BYTES of text."""
    read = zstandard.ZstdDecompressor().decompress if unpack else lambda t: t
    for batch in batches:
        at = n = 0
        texts: list[bytes] = []
        for i, t in enumerate(batch.column(column)):
            texts.append(read(t.as_py()) if t.is_valid else b"")
            n += len(texts[-1])
            if n >= CHUNK_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at), texts
                at, n, texts = i + 1, 0, []


def packed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, th, text) with texts compressed, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [codec.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "th", "text"])

    return rows.mapInArrow(run, "doc_id long, th long, text binary")


def find_anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, th, h: each anchor of each document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, 2):
            t = Text(texts, window)
            at = np.flatnonzero(t.whole)
            if not len(at):
                continue
            at = at[np.concatenate(([True], (t.anchor[at][1:] != t.anchor[at][:-1]) | (t.doc[at][1:] != t.doc[at][:-1])))]
            doc, h = distinct(t.doc[at], t.anchor[at])
            rows = pa.array(doc)
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h.view(np.int64))], ["doc_id", "th", "h"])

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id long, th long, h long")


def find_regions(docs: DataFrame, window: int) -> DataFrame:
    """docs have wanted, the anchors to look at: a row (h, salt, doc_id, th, s, n, words) for each run of n windows from word s on with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, 2, unpack=True):
            t = Text(texts, window)
            wanted = batch.column(3)
            offsets = np.asarray(wanted.offsets)
            flat = wanted.flatten()
            h, salts = np.asarray(flat.field("h")).view(np.uint64), np.asarray(flat.field("salts"))
            lists = np.repeat(np.arange(len(texts)), np.diff(offsets))
            at = np.flatnonzero(t.whole)
            if not len(at) or not len(h):
                continue
            new = np.concatenate(([True], (t.anchor[at][1:] != t.anchor[at][:-1]) | (t.doc[at][1:] != t.doc[at][:-1])))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(at)))
            s = at[first]
            # one ordering for both: number the anchors of this run of documents
            names, inv = np.unique(np.concatenate([h, t.anchor[s]]), return_inverse=True)
            code = lists * len(names) + inv[: len(h)]
            by = np.argsort(code, kind="stable")
            code = code[by]
            mine = t.doc[s] * len(names) + inv[len(h) :]
            place = np.minimum(np.searchsorted(code, mine), len(code) - 1)
            good = np.flatnonzero(code[place] == mine)
            if not len(good):
                continue
            chunks = salts[by][place[good]]
            s, count = s[good], count[good]
            begin, end = t.starts[s], t.ends[s + count + window - 2]
            raw = t.data.tobytes()
            rows = pa.array(t.doc[s])
            ids = np.asarray(batch.column(1).take(rows))
            salt = (mixed(ids.view(np.uint64)) % np.maximum(chunks, 1).astype(np.uint64)).astype(np.int32)
            text = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
            yield pa.record_batch(
                [pa.array(t.anchor[s].view(np.int64)), pa.array(salt), pa.array(chunks > 1), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((s - t.first[t.doc[s]]).astype(np.int32)), pa.array(count.astype(np.int32)), text],
                ["h", "salt", "split", "doc_id", "th", "s", "n", "words"],
            )

    return docs.mapInArrow(run, "h long, salt int, split boolean, doc_id long, th long, s int, n int, words binary")


def name_prefixes(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffix tree's node at the given depth of the suffix at each place: equal exactly for equal runs of ``depth`` ids, in lexicographic order."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < depth:
        more = min(span, depth - span)
        left, right = rank[: len(rank) - more], rank[more:]
        rank = np.unique(left * (int(rank.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        span += more
    return rank


def repeats_in(table: pa.Table, window: int) -> pa.RecordBatch | None:
    """Rows (doc_id, th, s, e, w1, w2): runs s to e (excluded) of words to remove; where w1 is set, one window from word s on to judge over all groups."""
    texts = table.column("words").to_pylist()
    t = Text(texts, window)
    doc, th, s0, n = (table.column(c).to_numpy() for c in ("doc_id", "th", "s", "n"))
    hashes = word_hashes(t.data, t.starts, t.ends)
    at = np.flatnonzero(t.whole)
    row = t.doc[at]
    node = np.unique(name_prefixes(hashes, window)[at], return_inverse=True)[1]
    least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[row])
    s = s0[row] + (at - t.first[row])
    gone = doc[row] > least[node]
    out = []
    if gone.any():
        k = np.flatnonzero(gone)
        cut = np.flatnonzero(np.concatenate(([True], (row[k][1:] != row[k][:-1]) | (s[k][1:] != s[k][:-1] + 1))))
        last = np.append(cut[1:], len(k)) - 1
        none = np.zeros(len(cut), np.int64)
        out.append((doc[row[k[cut]]], th[row[k[cut]]], s[k[cut]], s[k[last]] + window, none, none, np.zeros(len(cut), bool)))
    split = table.column("split").to_numpy(zero_copy_only=False)[row]
    if (more := split & ~gone).any():
        k = np.flatnonzero(more)  # every place: all that are left of a node have its least doc_id, which may hold the window more than once
        w1, w2 = gram_hashes(hashes, window)[at[k]], gram_hashes(mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)), window)[at[k]]
        out.append((doc[row[k]], th[row[k]], s[k], s[k] + window, w1.view(np.int64), w2.view(np.int64), np.ones(len(k), bool)))
    if not out:
        return None
    c = [np.concatenate(x) for x in zip(*out)]
    return pa.record_batch([pa.array(c[0]), pa.array(c[1]), pa.array(c[2].astype(np.int32)), pa.array(c[3].astype(np.int32)), pa.array(c[4], mask=~c[6]), pa.array(c[5], mask=~c[6])], ["doc_id", "th", "s", "e", "w1", "w2"])


def keep_words(docs: DataFrame, window: int) -> DataFrame:
    """docs have gone, runs of words (up to ALL: every word of a text that holds a window): doc_id, n_words, n_removed, spans, kept_text (kept words joined by one space)."""
    spans_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runs(batches, 1, unpack=True):
            rows = []
            for text, gone in zip(texts, batch.column(2).to_pylist()):
                own, spans, kept, at = text.split(), [], [], 0
                for g in sorted((g["s"], min(g["e"], len(own))) for g in gone or [] if g["e"] < ALL or len(own) >= window):
                    if spans and g[0] <= spans[-1]["e"]:
                        spans[-1]["e"] = max(spans[-1]["e"], g[1])
                    else:
                        spans.append({"s": g[0], "e": g[1]})
                for x in spans:
                    kept += own[at : x["s"]]
                    at = x["e"]
                kept += own[at:]
                rows.append((len(own), len(own) - len(kept), spans, b" ".join(kept).decode("utf-8", "replace")))
            n, m, spans, kept = zip(*rows)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<s:int,e:int>>, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed runs of words, end excluded) and kept_text of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(2), "text").alias("th2"), F.col("text").cast("binary").alias("text"))
    # equal texts are one entry, that of their least doc_id: the others lose all that windows cover, which is all
    names = rows.filter("doc_id is not null and text is not null").select("doc_id", "th", "th2")
    copied = common.cut(names.groupBy("th", "th2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"))
    copies = names.join(copied, ["th", "th2"]).filter("doc_id > lo").select("doc_id", "th").distinct()
    held = packed(rows.drop("th2")).repartition("doc_id", "th")
    found = common.cut(find_anchors(rows.drop("th2"), window).groupBy("th", "h").agg(F.min("doc_id").alias("doc_id")))
    keys = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    keys = keys.select("h", F.ceil(F.col("n") / group_rows).cast("int").alias("salts"))
    wanted = found.join(keys, "h").groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "salts")).alias("wanted"))
    regions = find_regions(held.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "wanted"), window)
    judged = common.by_group(regions, ["h", "salt"], lambda t: repeats_in(t, window), "doc_id long, th long, s int, e int, w1 long, w2 long", rows=TREE_ROWS)
    judged = common.cut(judged)
    over = judged.filter("w1 is not null")
    least = over.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"))
    late = over.join(least, ["w1", "w2"]).filter("doc_id > lo").select("doc_id", "th", "s", "e")
    gone = judged.filter("w1 is null").select("doc_id", "th", "s", "e").union(late).union(copies.select("doc_id", "th", F.lit(0).alias("s"), F.lit(ALL).alias("e")))
    gone = gone.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    return keep_words(held.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "gone"), window)
