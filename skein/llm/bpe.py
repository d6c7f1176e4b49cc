"""Byte-level BPE by traversal of a prefix-sharing trie.

A prefix of a word has one BPE encoding, and its last token decides how it goes on: the last token of w[:i] is the one token t that ends there and is
compatible with the last token of w[:i - len(t)], that is, the pair (that token, t) would be left alone by the merges (Antonov & van Antwerpen,
linear-time BPE). The distinct words of a batch are put in a trie; a depth-first walk gives each node its last token from its ancestors' states, so a
prefix that many words share is encoded once. Words read their tokens off the path; texts are their words' tokens in order.

Cases: null and empty texts have no tokens; special tokens in a text are single tokens, as the tokenizer file's added tokens say; a word of any length
is one path; repeated rows are encoded each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text into words for a byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def endings(ids: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """The lengths, longest first, of the tokens that end in given bytes: three of them, or two or one where no token is longer."""
    found: dict[bytes, set[int]] = {}
    for t in ids:
        found.setdefault(t[-3:], set()).add(len(t))
    return {k: tuple(sorted({n for j in range(len(k)) for n in found.get(k[j:], ()) if j == 0 or n == len(k) - j}, reverse=True)) for k in found}


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file."""

    def __init__(self, source: str):
        data = json.loads(source)
        model, letters = data["model"], byte_letters()
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space") or data.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = (self.ids[a], self.ids[b])
            self.rank[pair] = r
            self.parts[self.ids[a + b]] = (*pair, r)
        self.endings = endings(self.ids)
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.spelled = pa.array([self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)], pa.binary())

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges leave the token pair as it is: no earlier merge crosses the border while both sides are being built.

        The sides are taken apart from the last merge back; at each step the two tokens that then meet at the border must have no merge that would
        have run before the later of the merges undone so far (a tie of place goes to the left one).
        """
        key = left << 20 | right
        if (got := self.known.get(key)) is None:
            got = self.known[key] = self._compatible(left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        limit = len(self.rank) + 1.0
        while True:
            if (r := self.rank.get((left, right))) is not None and r < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[2] > b[2]:
                left, limit = a[1], a[2]
            else:  # of two equal merges the left one runs first, so the right one is undone first and ties with it are lost
                right, limit = b[0], b[2] + 0.5

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, tokens) of sorted distinct words: depth first through their trie, whose open path is held with the last token at each node."""
        ids, endings, known, compatible = self.ids, self.endings, self.known, self._compatible
        last: list[int] = []
        size: list[int] = []
        before = b""
        for word in words:
            n, shared = len(word), 0
            most = min(n, len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared:], size[shared:]
            for i in range(shared, n):
                end = i + 1
                lengths = endings.get(word[i - 2 : end]) if i > 1 else None
                for length in lengths or endings.get(word[i - 1 : end] if i else word[:1]) or endings[word[i:end]]:
                    start = end - length
                    if start < 0 or (t := ids.get(word[start:end])) is None:
                        continue
                    if start:
                        key = last[start - 1] << 20 | t
                        if (ok := known.get(key)) is None:
                            ok = known[key] = compatible(last[start - 1], t)
                        if not ok:
                            continue
                    last.append(t)
                    size.append(length)
                    break
                else:
                    raise ValueError("a byte has no token")
            before = word
            out, i = [], n
            while i:
                out.append(last[i - 1])
                i -= size[i - 1]
            yield word, out[::-1]

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text, as lists of int32."""
        find = regex.compile(WORDS).findall
        cut = [[(s, j % 2) for j, s in enumerate(self.split.split(t))] if self.split else [(t, 0)] for t in texts]
        cut = [[(find(s) if not special else s, special) for s, special in parts] for parts in cut]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.known) > 2 * CACHE_WORDS:
            self.known.clear()
        cache = self.cache
        new = set().union(*(words for parts in cut for words, special in parts if not special)).difference(cache)
        back = {w.encode(): w for w in new}
        for word, tokens in self.walk(sorted(back)):
            cache[back[word]] = array("i", tokens).tobytes()
        own, get = [], cache.__getitem__
        for parts in cut:
            own.append(b"".join([array("i", [self.added[words]]).tobytes() if special else b"".join(map(get, words)) for words, special in parts]))
        offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in own]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), np.int32)))

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The texts that lists of ids stand for. Tokens' bytes in a row are one buffer, which is cut where the lists end."""
        offsets = np.asarray(ids.offsets)
        spelled = self.spelled.take(ids.flatten())
        ends = np.frombuffer(spelled.buffers()[1], np.int32)[spelled.offset :][: len(spelled) + 1] if len(spelled) else np.zeros(1, np.int32)
        data = spelled.buffers()[2]
        raw = data.to_pybytes() if data is not None and len(spelled) else b""
        cuts = ends[offsets - offsets[0]].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


_loaded: dict[int, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """One Vocabulary for each worker process, which later tasks find again."""
    if (key := hash(source)) not in _loaded:
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of each row. tokenizer: the path, on the driver, of a tokenizer file; its few MB go to executors as a broadcast."""
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(source.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                yield pa.record_batch([batch.column(0).slice(a, b - a), v.encode(texts[a:b])], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of encode() with text: what the ids stand for."""
    with open(tokenizer, encoding="utf-8") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(source.value)
        for batch in batches:
            ids = batch.column(1)
            for a in range(0, len(ids), 500):
                own = ids.slice(a, 500)
                yield pa.record_batch([batch.column(0).slice(a, 500), own, pa.array(v.decode(own), pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
