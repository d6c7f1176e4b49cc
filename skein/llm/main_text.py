"""Main text of web pages by line-block distribution.

Markup is stripped to one line of text for each block element, and what pages repeat around an article (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) becomes a stretch of empty lines. A line weighs as many characters as stand outside links. The weights of a sliding window of
lines are summed; text surges where a sum rises from zero and dives where it falls back to zero, and what stands between is kept whole.

Where the page marks an article (or a main part), only its lines weigh, so lists of links in it fall out and short lines among its text stay. Elsewhere only lines that
read like text weigh: PROSE words or the end of a sentence, and no notice of rights; a stretch counts if its largest sum reaches SURGE characters or no other does, and it
reaches from its first such line, with the headings right before it, to its last. A page without any line of weight is kept as it is.

A class or id names furniture if one of its names is made of MARKS and NEUTRAL words only: ``site-footer`` and ``related-posts`` do, ``related-work`` and ``no-sidebar`` do not.

Cases: null or empty html, or a page without text, gives an empty text; unclosed elements end with their parent or the page; a page that is a text
without tags is one line; repeated rows and extra columns stay out of each other's way (only page_id, url and html are read); an empty table gives an
empty result; pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, PROSE = 3, 80, 5

# Element names of HTML.
HIDDEN = "script style noscript template svg math iframe object canvas audio video head select textarea button datalist map".split()
FURNITURE = "nav footer aside form dialog menu fieldset".split()
BLOCKS = (
    "address article aside blockquote body br-block center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead title tr ul caption"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
# Words of class and id names that mark what stands around an article.
MARKS = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "widget notice notices cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay comment comments commentlist respond disqus "
    "reply replies footer header masthead topbar toolbar share sharing social related recommended pagination pager alert skip"
).split()

# Words that say nothing of what an element holds.
NEUTRAL = (
    "site page post posts article articles entry entries content main left right top bottom upper lower inner outer first last primary secondary global box block section list items item wrap wrapper "
    "container area region zone slot bar row col column grid panel unit group inline fixed sticky mobile desktop small large wide links link buttons button icons icon title more stories news body author "
    "thread count meta info toggle open closed form text div leaderboard rectangle"
).split()
NEUTRAL_SET = frozenset(NEUTRAL)
RIGHTS = re.compile(r"(?i)(?:©|\(c\)\s|copyright\b|all rights reserved)")
SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")
HEADING = re.compile(r"h[1-6]$")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "math", "title")}
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME_WORD = re.compile(r"[a-z]+|\d+", re.I)
# First words of names that describe a layout, and words that name an article's own heading.
LAYOUT = "no with has without".split()
TITLE = "header masthead banner".split()
LAYOUT_SET, TITLE_SET = frozenset(LAYOUT), frozenset(TITLE)
HIDDEN_SET, FURNITURE_SET, BLOCK_SET, VOID_SET, ROLE_SET, MARK_SET = map(frozenset, (HIDDEN, FURNITURE, BLOCKS, VOID, ROLES, MARKS))


def marked_name(value: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id stands for furniture; in an article ``entry-header`` does not."""
    for name in value.split():
        found = NAME_WORD.findall(name)
        marks = [w for w in found if w in MARK_SET and not (in_article and w in TITLE_SET)]
        if marks and found[0] not in LAYOUT_SET and all(w in MARK_SET or w in NEUTRAL_SET or w.isdigit() for w in found):
            return True
    return False


def around(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element stands around an article rather than in it."""
    if name in HIDDEN_SET or name in FURNITURE_SET or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if value in ROLE_SET if key.lower() == "role" else marked_name(value, in_article):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, 2 in an article, 1 in the main part, else 0, characters outside links, heading) of each block; ("", 0, 0, False) for a block's worth of what stands around."""
    out: list[tuple[str, int, int, bool]] = []
    held: list[tuple[str, bool]] = []
    links, heading = 0, False
    depth_of = {"article": 0, "main": 0}
    at, skip, depth = 0, "", 0

    def end() -> None:
        if held:
            text = " ".join(entities.unescape("".join(t for t, _ in held)).split())
            own = sum(len("".join(entities.unescape(t).split())) for t, linked in held if not linked)
            held.clear()
            if text:
                out.append((text, 2 if depth_of["article"] else 1 if depth_of["main"] else 0, own, heading))

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            if not skip:
                held.append((page[at:], links > 0))
            break
        if not skip and m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if not closing and name in RAW_END and not attributes.endswith("/"):
            if name in HIDDEN_SET or name == "title":
                stop = RAW_END[name].search(page, at)
                at = stop.end() if stop else n
                continue
        inside = depth_of["article"] + depth_of["main"] > 0
        if skip:
            if name == skip and name not in VOID_SET:
                depth += -1 if closing else 1
                if depth <= 0:
                    skip = ""
            elif not closing and not inside and (name in ("main", "body") or name == "article" and not around(name, attributes, False)):
                skip = ""  # what was left open before an article ends there
            if skip or closing:
                continue
        if name == "br":
            held.append((" ", False))
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if not closing and name not in VOID_SET and around(name, attributes, inside):
            end()
            out.extend([("", 0, 0, False)] * WINDOW)
            if not attributes.rstrip().endswith("/"):
                skip, depth = name, 1
            continue
        if name in depth_of:
            end()
            depth_of[name] = max(0, depth_of[name] + (-1 if closing else 1))
        elif name in BLOCK_SET:
            end()
            links, heading = 0, not closing and HEADING.match(name) is not None
    end()
    return out


def prose(text: str) -> bool:
    """Whether a line reads like text rather than a label."""
    return not RIGHTS.match(text) and (len(text.split()) >= PROSE or SENTENCE.search(text) is not None or len(text) >= SURGE)


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, largest sum): runs of lines over which the sums of the window are not zero."""
    sums = [sum(weights[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(sums):
        if sums[i]:
            surge = i
            while i < len(sums) and sums[i]:
                i += 1
            out.append((surge, i, max(sums[surge:i])))
        i += 1
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    marked = max((level for _, level, _, _ in found), default=0)
    weights = [own if level == marked and (marked or prose(text)) else 0 for text, level, own, _ in found]
    if not any(weights):
        weights = [len(text) if level == marked else 0 for text, level, _, _ in found]
        return "\n".join(text for (text, _, _, _), w in zip(found, weights) if w)
    runs = stretches(weights)
    top = max(most for _, _, most in runs)
    keep: list[str] = []
    for surge, dive, most in runs:
        if marked:
            while surge and found[surge - 1][1] == marked and found[surge - 1][3]:  # a heading that is a link
                surge -= 1
        elif most < SURGE <= top:
            continue
        else:
            while not weights[dive - 1]:
                dive -= 1
            while surge and found[surge - 1][3]:
                surge -= 1
        keep += [text for text, level, _, _ in found[surge:dive] if text and level == marked]
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
