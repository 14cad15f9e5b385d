"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one per block.  A line weighs its text outside links, a list of links nothing.  The
weights of the lines in a sliding window are summed; where the sum surges past a threshold taken from the page itself a
passage begins, where it dives to nothing it ends.  Outside a marked article, at both ends a run of lines as short as menu entries is cut off.

Names are votes.  A part named as no article (menu, advert, comments) is taken out of the sequence, so that it cuts no
passage in two, unless it holds most of the page's text.  A marked article is believed if it holds most of what is left.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the characters at which a passage begins (less if the page has no window as full).
LINES, SURGE, SHARE = 3, 80, 0.5
#: The share of a line's characters inside links from which it counts as a list of links.
LINKED = 0.6
#: So many short lines in a row at an end of a passage are entries of a menu.
ENTRIES = 3
#: The share of the text around it from which a part is not believed to be no article: by its name, by a name of reader comments.
MOST, NEARLY_ALL = 0.8, 0.9
#: The share of the text left from which a marked article is believed.
MARKED = 0.5

# fixed values: elements of the HTML standard
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math select object audio video canvas".split())
_CHROME = frozenset("nav header footer aside form menu dialog button fieldset head search".split())
_CLOSES_P = _BLOCKS - frozenset("body head html li dd dt option optgroup td th tr tbody thead tfoot caption legend summary figcaption title".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# words of class, id and role names that mark parts that are no article
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promotion "
    "related respond reply replies share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets "
    "complementary contentinfo search signup login".split()
)
# words that say nothing, beside a word of the list above
_PLAIN = frozenset(
    "area bar block body bottom box center container content dropdown foot form global group head holder inner item items layout left link links "
    "list lower main mobile module outer page panel post primary region right row secondary section site slot sticky text top unit upper view wrap wrapper".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
_ARTICLE_NAMES = frozenset("article articlebody".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SENTENCE_END = tuple(".!?:;…。！？۔।\"'”»)")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Line(NamedTuple):
    text: str
    part: int  # innermost part that may be no article, -1 if none
    article: bool
    linked: float  # share of the text inside links
    heading: bool


class Part(NamedTuple):
    """A part that may be no article; ``most`` is the share of the page's text from which it is not believed."""

    outer: int
    most: float


def _marks(attributes: str) -> tuple[float | None, bool]:
    """From which share of the text the names of an element are not believed that it is no article, and whether it is the article.

    A name counts if all its words are known (``ad-box``, not ``share-prices`` or ``has-sidebar``).
    """
    most, article = None, False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return math.inf, False
        for name in value.split() if key != "aria-hidden" else ():
            words = {w.lower() for w in _WORD.findall(name)}
            if words & _NAMES and words <= _NAMES | _PLAIN:
                most = max(most or 0.0, NEARLY_ALL if words & _COMMENTS else MOST)
            article |= words <= _ARTICLE_NAMES | _PLAIN and bool(words & _ARTICLE_NAMES) or key == "role" and value.lower() == "main"
    return most, article


def page_lines(page: str) -> tuple[list[Line], list[Part]]:
    """The text of every block in page order, and the parts that may be no article; the time is linear in the page."""
    lines, parts, texts, linked = [], [], [], 0
    stack: list[tuple[str, int, bool]] = []  # name, part outside this element, article
    opened: Counter[str] = Counter()
    blocks, paragraphs = [], []  # places in the stack of blocks but p, and of p
    part, article, headings = -1, 0, 0

    def flush() -> None:
        nonlocal texts, linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                lines.append(Line(text, part, article > 0, min(1.0, linked / len(text)), headings > 0))
            texts, linked = [], 0

    def pop() -> None:
        nonlocal part, article, headings
        name, outside, was_article = stack[-1]
        if name in _BLOCKS or outside != part:
            flush()
        stack.pop()
        opened[name] -= 1
        if name == "p":
            paragraphs.pop()
        elif name in _BLOCKS:
            blocks.pop()
        part, article, headings = outside, article - was_article, headings - (name in _HEADINGS)

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else end]
        if text:
            texts.append(text)
            linked += len(text) if opened["a"] else 0
        if not found:
            break
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                texts.append(html.escape(found[0][9:].removesuffix("]]>"), quote=False))
            continue
        name, attributes = found[2].lower(), found[3]
        if found[1]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name == "p":
                flush()
            continue
        if name in _RAW:
            if name in _BLOCKS:
                flush()
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name == "br":
            texts.append(" ")
            continue
        if name in _CLOSES_P and paragraphs and (not blocks or blocks[-1] < paragraphs[-1]):
            # a block ends an open paragraph, and with it the inline elements left open in it
            for _ in range(len(stack) - paragraphs[-1]):
                pop()
        if name in _SIBLINGS and stack and stack[-1][0] in _SIBLINGS[name]:
            pop()
        if name in _BLOCKS:
            flush()
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
            continue
        most, is_article = _marks(attributes) if attributes else (None, False)
        if name in _CHROME and not (most is None and article and name in ("header", "hgroup")):  # but for the head of the article itself
            most = max(most or 0.0, MOST if name in ("form", "fieldset", "header") else math.inf)
        is_article = most is None and (is_article or name in ("article", "main"))
        if name in ("html", "body"):
            most, is_article = None, False
        stack.append((name, part, is_article))
        opened[name] += 1
        if name == "p":
            paragraphs.append(len(stack) - 1)
        elif name in _BLOCKS:
            blocks.append(len(stack) - 1)
        if most is not None:
            flush()
            parts.append(Part(part, most))
            part = len(parts) - 1
        article, headings = article + is_article, headings + (name in _HEADINGS)
    flush()
    return lines, parts


def _left_out(lines: list[Line], parts: list[Part], weights: list[int]) -> list[bool]:
    """Which parts are left out: those named as no article, and all that lies in one.

    One that holds most of the text stays, measured against what lies around it in no other such part.
    """
    sure = [p.most == math.inf for p in parts]
    own = [0] * (len(parts) + 1)  # the text in no inner part; the last is that in no part at all
    for i, p in enumerate(parts):
        sure[i] |= p.outer >= 0 and sure[p.outer]
    for line, weight in zip(lines, weights, strict=True):
        own[line.part] += weight
    held, around = own[:-1], [own[-1]] * (len(parts) + 1)
    for i in range(len(parts) - 1, -1, -1):
        if parts[i].outer >= 0 and not sure[i]:
            held[parts[i].outer] += held[i]
    for i, p in enumerate(parts):
        if p.outer >= 0:
            around[i] = around[p.outer] + own[p.outer]
    out = [sure[i] or held[i] <= p.most * (held[i] + around[i]) or held[i] < SURGE for i, p in enumerate(parts)]
    for i, p in enumerate(parts):
        out[i] |= p.outer >= 0 and out[p.outer]
    return out


def passages(weights: list[int]) -> list[tuple[int, int]]:
    """(begin, end) of the runs of lines between a surge and a dive of the window sums."""
    sizes = np.array(weights, np.int64)
    if not sizes.any():
        return []
    sums = np.convolve(sizes, np.ones(LINES, np.int64))[LINES - 1 :]  # of the window that begins at a line
    surge = min(SURGE, SHARE * sums.max())
    edges = np.flatnonzero(np.diff(np.concatenate([[0], sums > 0, [0]]).astype(np.int8)))
    runs = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    return [(begin, end) for begin, end in runs if sums[begin:end].max() >= surge]


def without_entries(lines: list[Line], weights: list[int], begin: int, end: int) -> tuple[int, int]:
    """The passage without runs of short lines at its ends.

    Short is less than half of what makes a surge, or of the longest line, and without the end of a sentence.  Fewer than
    ``ENTRIES`` of them are a title or a name and stay, and so does the last heading before the text with what follows it.
    """
    least = min(SURGE, max(weights[begin:end])) / 2
    full = [i for i in range(begin, end) if weights[i] >= least or lines[i].text.endswith(_SENTENCE_END) and weights[i]]
    if not full:
        return begin, end
    if sum(weights[i] > 0 for i in range(begin, full[0])) >= ENTRIES:
        begin = max((i for i in range(begin, full[0]) if lines[i].heading and weights[i]), default=full[0])
    if sum(weights[i] > 0 for i in range(full[-1] + 1, end)) >= ENTRIES:
        end = full[-1] + 1
    return begin, end


def main_text(page: str | None) -> str:
    """The kept lines of a page, joined by line feeds."""
    lines, parts = page_lines(page or "")
    weights = [0 if x.linked >= LINKED else round(len(x.text) * (1 - x.linked)) for x in lines]
    out = _left_out(lines, parts, weights)
    left = [(x, w) for x, w in zip(lines, weights, strict=True) if x.part < 0 or not out[x.part]]
    marked = sum(w for x, w in left if x.article)
    believed = marked > 0 and marked >= MARKED * sum(w for _, w in left)
    if believed:  # what lies outside cuts nothing in two, and lists of links inside are text
        left = [(x, len(x.text)) for x, _ in left if x.article]
    lines, weights = [x for x, _ in left], [w for _, w in left]
    ends = [run if believed else without_entries(lines, weights, *run) for run in passages(weights)]
    return "\n".join(lines[i].text for begin, end in ends for i in range(begin, end) if weights[i])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a page is handled by itself, and whole.

    NULL or empty html, and pages without main text, give an empty text.  Ids and urls pass as they are, NULL
    included; equal rows give equal rows; no rows give none.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
