"""Text functions: normal forms, graphemes, word segmentation, triage, diffs, a small language detector."""

from __future__ import annotations

import difflib
import html as entities
import lzma
import re
import time
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.html import graphemes, normalize
from skein.functions.url import pandas_map, url_at_start

_WHITE = regex.compile(r"[\p{Z}\p{Cc}\p{Cf}]+")
_SPLIT = regex.compile(r"[[\p{P}\p{S}]--[\-‐'’.]||[\p{Z}\p{Cc}\p{Cf}]]+", regex.V1)
_LEFT, _RIGHT = regex.compile(r"^[\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+"), regex.compile(r"[\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+$")
NONWORD = r"^[\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}\p{N}]+$"
_NONWORD = regex.compile(NONWORD)
_DNS_PATH = re.compile(r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+)+/")
ASCII_SPACE = " \t\n\f\r"
#: Texts of so many bytes are not segmented.
MOST_SEGMENTED = 83_886_080

Splitter = Callable[[str], list[str]]


def split_default(word: str) -> list[str]:
    return [word]


_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]+|[[\p{L}\p{M}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)


def split_chinese(word: str, words: frozenset[str] = frozenset(), longest: int = 4) -> list[str]:
    """Greedy longest match in a word list, single characters without one; other scripts stay whole. Runs are cut at 512 characters."""
    out = []
    for run in _CJK.findall(word):
        if not regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}]", run):
            out += [run[i : i + 512] for i in range(0, len(run), 512)]
            continue
        i = 0
        while i < len(run):
            k = next((k for k in range(min(longest, len(run) - i), 1, -1) if run[i : i + k] in words), 1)
            out.append(run[i : i + k])
            i += k
    return out


_ARABIC = regex.compile(r"(?<=[\p{L}\p{M}])(?=ال)|(?<=\p{Arabic})(?=[^\p{Arabic}\p{M}])|(?<=[^\p{Arabic}\p{M}])(?=\p{Arabic})", regex.V1)


def split_arabic(word: str) -> list[str]:
    """Before each article and where the script changes."""
    return [w for w in _ARABIC.split(word) if w]


#: By language; hooks for trained splitters of Thai, Japanese and Vietnamese.
SPLITTERS: dict[str, Splitter] = {"zh": split_chinese, "zh-Hant": split_chinese} | {lang: split_arabic for lang in ("ar", "fa", "ku", "ps", "ur")}


def register_splitter(lang: str, fn: Splitter) -> None:
    SPLITTERS[lang] = fn


def segment(lang: str | None, text: str | None) -> list[str]:
    """Words of a text: cut at white space; URLs pass as they are; then cut at symbols, trimmed, split by language, normalised and case-folded."""
    split = SPLITTERS.get(lang or "", split_default)
    out = []
    for chunk in _WHITE.split(text or ""):
        if not chunk:
            continue
        if u := url_at_start(chunk):
            out.append(u)
            continue
        for w in _SPLIT.split(chunk):
            if w := _RIGHT.sub("", _LEFT.sub("", w)):
                out += [unicodedata.normalize("NFKC", x).casefold() for x in split(w)]
    return out


def presegment(text: str | None) -> list[str]:
    return segment(None, text)


def segmented(lang: Column, text: Column) -> Column:
    """array<string> of words; null for a text too large."""

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for langs, texts in it:
            yield pd.Series([segment(a, t) if t is not None else None for a, t in zip(langs, texts)], dtype=object)

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.when(F.octet_length(text) < MOST_SEGMENTED, F.pandas_udf(run, "array<string>")(lang, text))


def normalized(text: Column) -> Column:
    return pandas_map(lambda t: None if t is None else normalize(t), "string")(text)


def n_graphemes(text: Column) -> Column:
    return pandas_map(lambda t: None if t is None else graphemes(t), "int")(text)


def is_nonword(text: Column) -> Column:
    return text.rlike(NONWORD)


def strip_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")


def split_ascii(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\f\r]+"), lambda w: w != "")


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit("�"))


def decode_lenient(data: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    return F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))


def token_class(word: Column) -> Column:
    """symbols, urls, numeric or words."""
    return (
        F.when(word.rlike(r"^[\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+$"), "symbols")
        .when(word.rlike(r"(?i)^(?:https?:|www\.)|^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,6}(?:/|$)"), "urls")
        .when(word.rlike(r"^[\p{N}\p{P}\p{S}]+$"), "numeric")
        .otherwise("words")
    )


def is_junk(word: str) -> bool:
    """Neither a word nor a name: no letters, or a host with a path."""
    return bool(_NONWORD.match(word) or _DNS_PATH.match(word))


#: Batches for a translator: words, characters, and the longest word.
BATCH_WORDS, BATCH_CHARS, WORD_CHARS = 128, 5_000, 750


def triage(words: list[str]) -> tuple[list[str], list[str]]:
    """(to translate, to leave as they are)."""
    ask = [w for w in words if not (_NONWORD.match(w) or url_at_start(w) or len(w) > WORD_CHARS)]
    known = set(ask)
    return ask, [w for w in words if w not in known]


def batches(words: list[str], most: int = BATCH_WORDS, chars: int = BATCH_CHARS) -> list[list[str]]:
    """Words in order in batches that hold the limits."""
    out: list[list[str]] = []
    size = 0
    for w in words:
        if not out or len(out[-1]) >= most or size + len(w) > chars:
            out.append([])
            size = 0
        out[-1].append(w)
        size += len(w)
    return out


def translate(words: DataFrame, translations: DataFrame, doc: str = "doc_id") -> DataFrame:
    """words (doc, pos, lang, word) with translations (lang, word, engl): ``languages,words`` of each document; what has none stays, squeezed."""
    own = words.join(translations, ["lang", "word"], "left")
    fold = pandas_map(lambda w: None if w is None else unicodedata.normalize("NFKC", w).casefold(), "string")
    text = F.regexp_replace(F.trim(F.coalesce("engl", fold(F.col("word")))), r"\s+", " ")
    per = own.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("langs"), F.array_sort(F.collect_list(F.struct("pos", text.alias("w")))).alias("ws"))
    return per.select(doc, F.concat_ws(",", "langs", F.array_join(F.transform("ws", lambda s: s["w"]), " ")).alias("text"))


def language_alias(lang: Column, back: bool = False) -> Column:
    """Codes as the segmenter names them; ``back``: as the translator does."""
    here, there = ("zh-Hant", "zh-TW") if back else ("zh-TW", "zh-Hant")
    return F.when(lang == here, there).otherwise(lang)


def segment_lines(segs: Column) -> Column:
    """``lang  word`` of array<struct<l,t>>."""
    return F.flatten(F.transform(segs, lambda s: F.transform(s["t"], lambda w: F.concat(s["l"], F.lit("  "), w))))


def diff_lines(a: list[str] | None, b: list[str] | None) -> str:
    return "\n".join(difflib.unified_diff(a or [], b or [], lineterm="", n=1))


def unescape(text: Column) -> Column:
    return pandas_map(lambda t: None if t is None else entities.unescape(t), "string")(text)


def fragment_text(text: Column) -> Column:
    """Plain text of a piece of HTML."""
    return pandas_map(lambda t: None if t is None else normalize(entities.unescape(re.sub(r"<[^>]*>", " ", t))), "string")(text)


def chunks(text: Column, width: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / width).cast("int"), F.lit(0)))
    return F.transform(starts, lambda i: F.substr(text, i * width + 1, F.lit(width)))


def unzip(data: Column) -> Column:
    """Inflated bytes; empty where they cannot be."""

    def one(b: bytes | None) -> bytes | None:
        try:
            return None if b is None else zlib.decompress(b)
        except zlib.error:
            return b""

    return pandas_map(one, "binary")(data)


def compressed_sizes(text: Column) -> Column:
    """struct of bytes: raw, zlib default, zlib 9, LZMA2, delta and LZMA2; and the CPU seconds of each (tz, tz9, tx, tdx)."""
    ways = [zlib.compress, lambda b: zlib.compress(b, 9)]
    ways += [lambda b, f=f: lzma.compress(b, lzma.FORMAT_RAW, filters=f) for f in ([{"id": lzma.FILTER_LZMA2}], [{"id": lzma.FILTER_DELTA}, {"id": lzma.FILTER_LZMA2}])]

    def sizes(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            b = (t or "").encode()
            sizes, times = [], []
            for way in ways:
                began = time.process_time()
                sizes.append(len(way(b)))
                times.append(time.process_time() - began)
            rows.append((len(b), *sizes, *times))
        return pd.DataFrame(rows, columns=["raw", "z", "z9", "x", "dx", "tz", "tz9", "tx", "tdx"])

    sizes.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(sizes, "raw int, z int, z9 int, x int, dx int, tz double, tz9 double, tx double, tdx double")(text)


# Frequent words of some languages for the small detector.
COMMON = {
    "en": "the of and to in is that it was for on with as be by this have from are not or an at".split(), "fr": "le la les de des et en un une du est que pour dans par sur pas qui au avec ce".split(),
    "de": "der die das und in den von zu mit ist des ein eine nicht auch auf für im dem sich als".split(), "es": "el la los las de y en un una que por con para del se no es su al lo".split(),
    "it": "il la di che e un una per non in sono con del della le si da".split(), "pt": "o a os as de e que em um uma para com não do da se por".split(), "nl": "de het een van en in is dat op te zijn met voor niet aan".split(),
}
_SCRIPTS = {"ru": regex.compile(r"\p{Cyrillic}"), "ar": regex.compile(r"\p{Arabic}"), "zh": regex.compile(r"\p{Han}"), "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "ko": regex.compile(r"\p{Hangul}"), "th": regex.compile(r"\p{Thai}"), "el": regex.compile(r"\p{Greek}"), "he": regex.compile(r"\p{Hebrew}")}


def language_scores(text: str | None) -> list[tuple[str, float]]:
    """One to three (language, share), best first; unknown stands alone."""
    words = [w for w in regex.findall(r"\p{L}+", (text or "").lower())]
    if not words:
        return [("un", 0.0)]
    score = {lang: sum(w in own for w in words) / len(words) for lang, own in ((k, frozenset(v)) for k, v in COMMON.items())}
    letters = sum(map(len, words))
    for lang, script in _SCRIPTS.items():
        score[lang] = len(script.findall("".join(words))) / letters
    if score["ja"] > 0.05:
        score["ja"] += score.pop("zh")
    best = sorted(((s, k) for k, s in score.items() if s > 0.02), key=lambda p: (-p[0], p[1]))[:3]
    if not best or best[0][0] < 0.08 or len(best) > 1 and best[0][0] < 1.1 * best[1][0]:
        return [("un", 0.0)]
    return [(k, round(s, 4)) for s, k in best]


def detect(text: Column, model: Callable[[str | None], list[tuple[str, float]]] = language_scores) -> Column:
    """array<struct<l,s>> by a pluggable detector."""
    return pandas_map(lambda t: [{"l": a, "s": float(s)} for a, s in model(t)], "array<struct<l:string,s:double>>")(text)


def language_runs(text: str | None, model: Callable = language_scores) -> list[tuple[str, str]]:
    """(language, text) of runs of lines in one language."""
    out: list[tuple[str, str]] = []
    for line in (text or "").split("\n"):
        lang = model(line)[0][0]
        if out and (out[-1][0] == lang or lang == "un"):
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{line}")
        else:
            out.append((lang, line))
    return out
