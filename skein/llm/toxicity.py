"""Toxicity of texts by noisy-channel deobfuscation.

A character language model (trigrams of letters that have case, with word borders, over the distinct words of the whole corpus) is the source. The channel writes
letters as look-alikes, repeats them, and puts signs or spaces between them. A disguised stretch of any length is a lattice of what each character can stand for;
the Viterbi path under model and channel restores it, a space between letters being nothing or a word border. Words that are letters throughout without long repeats have one
path and pass as they are. Restored texts are scored by a logistic regression on the presence of words and word beginnings.

The classifier is fitted on a bounded sample: the LABELLED rows of labels that sort first by hash, and the FEATURES features that tell their labels apart
best. The language model's counts cover every row, every word counts once, and a trigram seen in LEAST_SEEN words is kept; so the model does not depend on how rows are
dealt to partitions, and its size is bounded by the alphabets, not by a cap.

Cases: null and empty texts get the score of a text without features; labels that are null are not learned from, and a doc_id labelled twice counts
as toxic if either says so; without labels of both kinds every score is the share of toxic labels (0 without any); ties in the selection go by name;
repeated rows are scored each; extra columns are not read; an empty table gives an empty result. Texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED, FEATURES = 20_000, 4_096
PREFIXES = (4, 5)
#: The language model's table: trigrams of letters, kept if seen in so many distinct words of the corpus.
LEAST_SEEN = 2
CACHE_WORDS = 60_000
#: Distinct words or features that a worker holds before it hands their counts on.
HELD = 120_000
#: Longer stretches are restored without being remembered.
CACHED_SPAN = 64

# Look-alikes of letters.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
SIGNS = set(" .,-_*'~^`·•/\\#%&=:;")
#: Of a look-alike, a sign between letters, a letter more of a run of three or more, a letter of a double one, a sign that is rather a look-alike, a
#: space that ends a word.
LOOK_COST, SIGN_COST, REPEAT_COST, DOUBLE_COST, ODD_COST, BORDER_COST = 0.7, 0.4, 0.3, 3.0, 4.0, 1.0

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'.,;:!?()[]{}<>«»“”‘’¡¿*%&#$|-_~`^/\\+=@…"
#: Signs at a word's edge that stand for no letter.
SOFT_EDGES = "".join(c for c in EDGES if c not in LOOKS)
CASED = regex.compile(r"\p{Ll}+")
LETTERS = re.compile(r"[^\W\d_]+")
THRICE = re.compile(r"([^\W\d_])\1\1")
#: Single letters or look-alikes with one sign or space between them, three at least.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*'~/][^\W_]){2,}(?![^\W_])")


def trigrams(words: Iterable[str]) -> Counter:
    out: Counter = Counter()
    for w in words:
        w = f"^{w}$"
        out.update(map("".join, zip(w, w[1:], w[2:])))
    return out


def clean(word: str) -> str:
    return word.strip(EDGES)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """gram, n: in how many distinct words of docs each letter trigram stands."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()

        def flush() -> pa.RecordBatch:
            found = {c for w in held if len(c := clean(w)) > 1 and CASED.fullmatch(c)}
            held.clear()
            return pa.record_batch([pa.array(found, pa.string())], ["word"])

        for batch in batches:
            for t in batch.column(0):
                held.update((t.as_py() or "").lower().split())
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = trigrams(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["gram", "n"])

    words = docs.select("text").mapInArrow(words_of, "word string").distinct()
    return words.mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Restorer:
    """Viterbi decoder of disguised stretches."""

    counts: dict[str, int]
    pairs: dict[str, int] = field(default_factory=dict)
    cost: dict[str, float] = field(default_factory=dict)
    cache: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for g, n in self.counts.items():
            self.pairs[g[:2]] = self.pairs.get(g[:2], 0) + n
        self.letters = max(2, len({g[2] for g in self.counts}))

    def price(self, gram: str) -> float:
        if (got := self.cost.get(gram)) is None:
            if len(self.cost) > 2 * CACHE_WORDS:
                self.cost.clear()
            got = self.cost[gram] = -math.log((self.counts.get(gram, 0) + 0.05) / (self.pairs.get(gram[:2], 0) + 0.05 * self.letters))
        return got

    def restore(self, span: str) -> str:
        if len(span) > CACHED_SPAN:
            return self._restore(span)
        if (got := self.cache.get(span)) is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            got = self.cache[span] = self._restore(span)
        return got

    def _restore(self, span: str) -> str:
        """States are the last two letters written; a character writes a letter, nothing (a sign), nothing more (a repeat), or a word border (a space).

        A state holds its cost and the way to it, a chain of letters from the last one back; of ways of equal cost the first stays.
        """
        start = "^"
        states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
        bare = [c for c in span if c not in SIGNS]
        runs = [n for _, own in groupby(bare) for n in [len(list(own))] for _ in range(n)]
        place = 0
        for c in span:
            again = REPEAT_COST if c not in SIGNS and runs[place] > 2 else DOUBLE_COST
            place += c not in SIGNS
            after: dict[str, tuple[float, tuple | None]] = {}

            def go(key: str, value: float, way: tuple | None, after=after) -> None:
                if key not in after or value < after[key][0]:
                    after[key] = (value, way)

            writes = [(c, 0.0)] if c.isalpha() else [(x, LOOK_COST) for x in LOOKS.get(c, "")]
            for key, (value, way) in states.items():
                for x, extra in writes:
                    step = self.price(key + x) if len(key) == 2 else 0.0
                    go(key[-1] + x, value + extra + step, (x, way))
                    if key != start and key[-1] == x:
                        go(key, value + extra + again, way)
                if c in SIGNS or not writes or c in "!|+($":
                    go(key, value + (SIGN_COST if c in SIGNS else ODD_COST), way)
                if c == " " and len(key) == 2:
                    go(start, value + BORDER_COST + self.price(key + "$"), (" ", way))
            states = after
        ends = [(value + (self.price(key + "$") if len(key) == 2 else 0.0), way) for key, (value, way) in states.items()]
        out = []
        way = min(ends, key=lambda e: e[0])[1] if ends else None
        while way:
            out.append(way[0])
            way = way[1]
        return "".join(reversed(out))

    def features(self, text: str | None) -> set[str]:
        """The distinct words of the restored text and their beginnings."""
        low = (text or "").lower()
        seen = set(low.split())
        words = {clean(w) for w in seen}
        # look-alikes at a word's edge may be letters: both readings count
        odd = {w for w in words | {x.strip(SOFT_EDGES) for x in seen} if len(w) > 2 and (not w.isalpha() or THRICE.search(w))}
        restored = {self.restore(w) for w in odd if any(c.isalpha() for c in w)}
        for m in SPACED.findall(low):
            restored.update(self.restore(m).split())
        for w in odd:
            words.update(LETTERS.findall(w))
        words |= restored
        words.discard("")
        return words | {f"{w[:k]}~" for k in PREFIXES for w in words if len(w) > k}


@dataclass
class Model:
    counts: dict[str, int]
    weights: dict[str, float]
    bias: float


def fit_regression(rows: list[list[int]], labels: list[int], width: int, l2: float = 0.05, turns: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features by accelerated gradient steps; the bias is not shrunk."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(rows)), sizes)
    y = np.array(labels, float)
    held = np.bincount(at, minlength=width)
    step = 1.0 / (np.maximum(held, 1) * 0.25 * max(1.0, np.percentile(sizes, 95) ** 0.5) + l2)
    w, b = np.zeros(width), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w0, b0 = w, b
    for k in range(turns):
        m = k / (k + 3)
        v, c = w + m * (w - w0), b + m * (b - b0)
        z = np.bincount(of, v[at], len(rows)) + c
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w0, b0 = w, b
        w, b = v - step * (np.bincount(at, error[of], width) + l2 * v), c - 4.0 / len(y) * error.sum()
    return w, float(b)


def learn_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, toxic of at most ``most`` labelled rows: the bounded sample."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, width: int = FEATURES) -> Model:
    """docs: doc_id and text of the whole corpus; labels: the rows that may be learned from."""
    spark = docs.sparkSession
    grams = count_trigrams(docs).filter(F.col("n") >= LEAST_SEEN)
    counts = {r["gram"]: r["n"] for r in sorted(grams.collect())}  # as many as alphabets have
    shared = spark.sparkContext.broadcast(counts)
    sample = [(r["doc_id"], r["toxic"]) for r in learn_sample(labels, most).collect()]
    total, toxic = len(sample), sum(y for _, y in sample)
    if not total or toxic in (0, total):
        p = toxic / total if total else 0.0
        return Model(counts, {}, 30.0 * (1 if p >= 1 else -1) if p in (0.0, 1.0) else math.log(p / (1 - p)))
    chosen = F.broadcast(spark.createDataFrame(sample, "doc_id long, toxic int"))  # at most ``most`` rows of 12 bytes
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("text", "toxic")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = sorted({*seen[0], *seen[1]})
            out = pa.record_batch([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["f", "pos", "neg"])
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[label].update(restorer.features(text.as_py()))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield flush()
        yield flush()

    tallied = train.mapInArrow(tally, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, n = toxic, total - toxic
    gain = F.col("pos") * F.log((F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1) * (total / p))
    best = tallied.filter((F.col("pos") >= 2) & (F.col("pos") * n > 2 * F.col("neg") * p)).orderBy(F.desc(gain), "f").limit(width)
    names = [r["f"] for r in best.select("f").collect()]
    if not names:
        return Model(counts, {}, math.log(p / n))
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, places = Restorer(shared.value), index.value
        for batch in batches:
            rows = [sorted(places[f] for f in restorer.features(t.as_py()) if f in places) for t in batch.column(0)]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], ["x", "toxic"])

    rows = train.mapInArrow(present, "x array<int>, toxic int").collect()  # the bounded sample
    rows = sorted((list(r["x"]), r["toxic"]) for r in rows)
    w, b = fit_regression([x for x, _ in rows], [y for _, y in rows], len(names))
    return Model(counts, {f: float(x) for f, x in zip(names, w) if x}, b)


def score(docs: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """keep columns, then score and predicted of each row. The model's size is bounded by its parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    n = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer, weight = Restorer(m.counts), m.weights
        known = weight.keys()
        for batch in batches:
            z = [m.bias + math.fsum(weight[f] for f in restorer.features(t.as_py()) & known) for t in batch.column(n)]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]
            yield pa.record_batch([*batch.columns[:n], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], [*batch.schema.names[:n], "score", "predicted"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("score", "double").add("predicted", "integer"))
