"""The main text of web pages.

The standard library's parser streams events; they become lines, one per block of text, each with
the number of tags met in it and the containers it lies in. Lines in elements that never hold an
article (menus, footers, forms, scripts) are left out, and those in elements whose class, id or role
names another part of a page, unless such an element holds an article, or most of the text of
a page without one: then it is layout. The text-to-tag ratio of the remaining lines is smoothed with a Gaussian and
split by a threshold between two clusters; a container with a line in the upper cluster is a
content region and is taken whole, so short paragraphs of an article stay. Articles with a fair
share of the content are the regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the HTML standard by their role here.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video "
                   "select datalist textarea button head title".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div "
                   "dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                   "hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
                   "th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
# A start of the left element ends an open one on the right, up to the nearest list or table.
ENDS_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = frozenset("ul ol dl table".split())

# Words of class, id and role that name other parts of a page.
HINTS = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs
comment comments consent cookie cookies discussion disqus footer masthead menu modal nav navbar
navigation newsletter notice pagination pager popup promo promoted promotion related respond
share sharing sidebar skip social sponsor sponsored subscribe toolbar widget complementary
contentinfo search alert replies reply reviews""".split())
# Of these, names of what readers write; an element so called is never layout.
READERS = frozenset("comment comments discussion disqus respond replies reply reviews".split())
# Beside a hint, words that say what a page has, not what an element is.
ABOUT = frozenset("closed disabled enabled has hide no not off on open with without".split())

SIGMA = 1.0
FAIR = 0.2
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]+")


class Line(NamedTuple):
    text: str
    tags: int
    container: int  # number of the nearest container
    article: int  # number of the outermost article or main element; 0 outside
    hint: int  # number of the nearest element around it that a hint names; 0 if none


class Hint(NamedTuple):
    around: int  # number of the next element outwards that a hint names; 0 if none
    readers: bool  # readers write in it


class _Lines(HTMLParser):
    """Collects lines. Work per event does not grow with the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple] = []  # tag, hides, container, article, hint
        self.places: dict[str, list[int]] = {}  # of open elements by tag
        self.hints: dict[int, Hint] = {}
        self.layout: set[int] = set()  # elements with a hint that hold an article
        self.parts: list[str] = []
        self.tags, self.elements = 0, 0

    def _state(self) -> tuple[bool, int, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0, 0)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        hides, container, article, hint = self._state()
        if text and not hides:
            self.lines.append(Line(text, max(self.tags, 1), container, article, hint))
        self.parts.clear()
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        self._end_implied(tag)
        self.tags += 1
        if tag in EMPTY:
            if tag == "br":
                self.parts.append(" ")
            return
        hides, container, article, hint = self._state()
        self.elements += 1
        hides = hides or tag in SILENT or tag in ASIDE or self._aside(tag, attrs, article)
        named = self._named(tag, attrs)
        if named:
            hides = hides or tag not in BLOCKS
            self.hints[self.elements] = Hint(hint, "readers" in named)
            hint = self.elements
        if tag in ("article", "main") and not hides and not named:
            around = hint
            while around and around not in self.layout:
                self.layout.add(around)
                around = self.hints[around].around
        if tag in CONTAINERS:
            container = self.elements
        if tag in ("article", "main") and not article:
            article = self.elements
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hides, container, article, hint))

    @staticmethod
    def _aside(tag: str, attrs, article: int) -> bool:
        if tag == "header":
            return not article  # an article's own header holds its heading
        if tag in ("html", "body"):
            return False
        return any(name == "hidden" or (name == "aria-hidden" and value in (None, "", "true"))
                   or (name == "style" and value and _HIDDEN.search(value.lower()))
                   for name, value in attrs)

    @staticmethod
    def _named(tag: str, attrs) -> frozenset[str] | None:
        """What a hint says: None without one, {"readers"} if a name holds one of READERS."""
        if tag in ("html", "body", "main", "header"):
            return None
        found = None
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for part in value.split():
                    words = _LETTERS.findall(_CASE.sub("-", part).lower())
                    if HINTS.isdisjoint(words) or not ABOUT.isdisjoint(words):
                        continue
                    if not READERS.isdisjoint(words):
                        return frozenset(["readers"])
                    found = frozenset(["part"])
        return found

    def _nearest(self, tags) -> int:
        """Place of the nearest open element with one of these tags; -1 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def _end_implied(self, tag: str) -> None:
        """Close the elements that a start of `tag` ends."""
        if tag in ENDS_P and self.places.get("p"):
            self._pop("p")
        if (ends := IMPLIED.get(tag)) and (at := self._nearest(ends)) > self._nearest(FENCES):
            self._pop(self.open[at][0])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        self._pop(tag)

    def _pop(self, tag: str) -> None:
        """Close the nearest open `tag` and all within it; nothing if there is none."""
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if at < len(self.open) - 1 or tag in BLOCKS:
            self._end_line()
        for name, *_ in self.open[at:]:
            self.places[name].pop()
        del self.open[at:]

    def handle_data(self, data):
        if not self._state()[0]:
            self.parts.append(data)

    def close(self):
        super().close()
        self._end_line()


def lines_of(html: str) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return _shown(parser.lines, parser.hints, parser.layout)


def _shown(lines: list[Line], hints: dict[int, Hint], layout: set[int]) -> list[Line]:
    """The lines outside elements with a hint. One that holds an article, or most of the text of a
    page without one, is layout and hides nothing, unless readers write in it.

    If no line is left, those that readers did not write stay, else all.
    """
    size = dict.fromkeys(hints, 0)
    for line in lines:
        if line.hint:
            size[line.hint] += len(line.text)
    for h in sorted(hints, reverse=True):  # what lies within has the larger number
        if hints[h].around:
            size[hints[h].around] += size[h]
    total = sum(len(line.text) for line in lines)
    readers = {0: False}
    for h in sorted(hints):
        readers[h] = readers[hints[h].around] or hints[h].readers
    named = any(line.article > line.hint and not readers[line.hint] or line.article
                and line.hint in layout for line in lines)
    removed = {0: False}
    for h in sorted(hints):
        most = not named and 2 * size[h] > total
        removed[h] = removed[hints[h].around] or readers[h] or not (h in layout or most)
    for hidden in (removed, readers):
        shown = [line for line in lines if not hidden[line.hint]]
        if shown:
            return shown
    return lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios smoothed with a Gaussian that is cut at three sigma and at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma ** 2))
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach:reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters; the least value if there is one cluster."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            return float(values.min())
        new = float(low.mean() + high.mean()) / 2
        if new == cut:
            break
        cut = new
    return cut


def extract(html: str | None) -> str:
    """The main text: its blocks in page order, each on a line; empty if there is none.

    Regions are article and main elements, outside of them containers; those with content lines
    are taken. What is outside articles goes, unless they hold less than a FAIR share of the content.
    """
    lines = lines_of(html) if html else []
    if not lines:
        return ""
    ratios = smoothed(np.array([len(line.text) / line.tags for line in lines]))
    content = ratios >= threshold(ratios)
    sizes = {True: 0, False: 0}  # of content lines in and outside articles
    for line, c in zip(lines, content):
        sizes[line.article > 0] += len(line.text) if c else 0
    if any(line.article for line in lines) and sizes[True] >= FAIR * sum(sizes.values()):
        region = [line.article for line in lines]
        chosen = {r for r, c in zip(region, content) if r and c} or set(region) - {0}
    else:
        region = [line.article or line.container for line in lines]
        chosen = {r for r, c in zip(region, content) if c}
    return "\n".join(line.text for line, r in zip(lines, region) if r in chosen)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row, from the whole html; a null html is empty.

    An empty table gives no rows; repeated rows and null ids come out as they came in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
