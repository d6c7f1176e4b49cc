"""Language identification by compression with per-language dictionaries.

Each language gets a raw-content zstandard dictionary cut from its training texts. A text is compressed with every dictionary, and the language whose
dictionary leaves the fewest bytes is chosen; where another comes within MARGIN of it, the choice is marked as rejected.

The dictionaries are fitted on a bounded sample: of each language the TEXTS distinct texts that sort first by a hash of the text, so copies weigh nothing and
order and partitions do not matter. A sampled text of more than PIECE characters gives four stretches that lie evenly over all of it; a dictionary takes the same
number of bytes of each of its texts, as many as fill DICTIONARY_BYTES, and what short texts leave goes to the longer ones.

Cases: null text, empty text and text without a letter are ``und`` with score 0; texts whose lang is null are never learned from; without any training
text everything is ``und``; ties go to the language that sorts first; repeated rows and extra columns change nothing; an empty table gives an empty
result. Texts are compressed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import common

#: The bounded sample: distinct texts of a language, bytes of its dictionary, characters of a text.
TEXTS, DICTIONARY_BYTES, PIECE = 400, 131_072, 8_192
LEVEL = 5
MARGIN = 0.02
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> str:
    """Letters in lower case, all else one space."""
    return OTHER.sub(" ", text.lower()).strip()


def dictionary(pieces: list[str]) -> bytes:
    """Raw content that holds the same share of each of the texts."""
    own = sorted({plain(p).encode("utf-8", "replace") for p in pieces}, key=lambda d: (len(d), d))
    out, left = [], DICTIONARY_BYTES
    for i, data in enumerate(own):  # the shorter ones first: what they leave is for the others
        out.append(data[: max(0, left // (len(own) - i) - 1)])
        left -= len(out[-1]) + 1
    return b" ".join(sorted(out))


def stretches(text: Column, most: int = PIECE, parts: int = 4) -> Column:
    """The text, or parts of it that lie evenly over it and have ``most`` characters together."""
    each = most // parts
    at = lambda k: F.floor((F.length(text) - each) * k / (parts - 1)).cast("int") + 1
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws(" ", *[F.substr(text, at(k), F.lit(each)) for k in range(parts)]))


def fit(docs: DataFrame, texts: int = TEXTS) -> dict[str, bytes]:
    """Dictionary content by language, from the (bounded) sample of docs. docs: text, lang."""
    known = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit(31), "text").alias("h"))
    distinct = common.cut(known.select("lang", "h").distinct())  # copies are one text
    counts = {row["lang"]: row["count"] for row in distinct.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return {}
    # of a large language only the hashes near the bottom can be among the first, so no task ranks more than a few times ``texts`` rows of it
    most = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2.0 * texts + 64) / n))])
    low = distinct.filter(F.shiftrightunsigned("h", 11) / F.lit(2.0**53) < most[F.col("lang")])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h"))
    chosen = F.broadcast(low.withColumn("rank", first).filter(F.col("rank") <= texts).select("lang", "h"))  # at most ``texts`` rows of each language
    pieces: dict[str, list[str]] = {}
    rows = known.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min(stretches(F.col("text"))).alias("piece"))
    for row in rows.collect():
        pieces.setdefault(row["lang"], []).append(row["piece"])
    return {lang: dictionary(own) for lang, own in sorted(pieces.items())}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.codecs = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang] or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.codecs.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))
        self.floor = [len(c.compress(b"")) for c in self.codecs]

    def __call__(self, text: str | None) -> tuple[str, float, bool, list[int]]:
        """(language, score, rejected, bytes by language)."""
        data = plain(text or "").encode("utf-8", "replace")
        if not self.langs or not LETTER.search(text or ""):
            return "und", 0.0, True, []
        sizes = [len(c.compress(data)) - f for c, f in zip(self.codecs, self.floor)]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = min(rest) / max(1, sizes[best]) - 1 if rest else 1.0
        score = 1 / sum(math.exp(max(-50.0, -(s - sizes[best]) * 25 / max(25, sizes[best]))) for s in sizes)
        return self.langs[best], score, margin < MARGIN, sizes


def predict(docs: DataFrame, content: dict[str, bytes], *keep: str | Column) -> DataFrame:
    """keep columns, then lang_pred, score, rejected and sizes of each row. content has a bounded size for each language and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    n = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            got = [classify(t.as_py()) for t in batch.column(n)]
            lang, score, rejected, sizes = zip(*got) if got else ((), (), (), ())
            yield pa.record_batch([*batch.columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(sizes, pa.list_(pa.int32()))], [*batch.schema.names[:n], "lang_pred", "score", "rejected", "sizes"])

    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean").add("sizes", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)
