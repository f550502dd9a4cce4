"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The page is read as a stream of standard-library parser events. A line is the text of one block; its ratio is its
length outside links over the tags it holds. Smoothed ratios over a threshold (their standard deviation, at most their
mean) are content; the articles with content, else the smallest element that holds all of it, are the region. Lines of
the region that are not mostly links are kept, short ones too; lines of links only where the smoothed ratio says that
they stand in the article, so that lists of links, which have only their like beside them, go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
#: A line with so much of its text in links is one of links.
LINKED = 0.8

# fixed values: element and attribute names of HTML
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_SILENT = frozenset("aside button canvas dialog fieldset footer form head iframe input label map menu nav noscript object option script search select style svg template textarea title".split())
_HOLDERS = frozenset("body center dd div html li section table td".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_MARKS = frozenset(
    "ad ads advert advertisement advertising advertorial adsense adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright discussion disqus dropdown footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notification "
    "pagination paywall popup promo promotion recommendations recommended related replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
_IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
#: A form or a marked element with so much of the page's text is a wrapper of the page.
_WRAPPER = 0.9
_ONLY_OUTSIDE = frozenset(["header"])
_NEGATIONS = frozenset(["has", "no", "not", "with", "without"])
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section div main body html td th".split())


def _marked(value: str, marks: frozenset[str]) -> bool:
    for word in value.lower().split():
        parts = re.split(r"[-_]+", word)
        if word in marks or parts[0] in marks or parts[-1] in marks and parts[0] not in _NEGATIONS:
            return True
    return False


class _Lines(HTMLParser):
    """Collects every block outside silent elements: its texts, tags and path (numbers of the open elements).

    A form or marked element is soft: whether it is silent is seen when the page has been read. A text has the number of
    the innermost soft element around it, or -1, and whether it is in a link.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.outer: dict[int, int] = {}  # of soft elements: the soft element around, or -1
        self.size: dict[int, int] = {-1: 0}  # characters whose innermost soft element it is
        self.holds: dict[int, bool] = {}  # whether an article or main element is inside
        self.in_article: dict[int, bool] = {}  # whether some of those characters are in an article or main element
        self.open: list[tuple[str, int, bool, int]] = []  # name, number, silent, innermost soft element
        self.names: list[str] = []  # by number
        self.blocks: list[tuple[list[tuple[str, int, bool]], int, tuple[int, ...]]] = []
        self.text: list[tuple[str, int, bool]] = []
        self.tags = 0
        self.inside = self.links = 0  # open article and main elements, and links

    def _silent(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        if tag in _SILENT - {"form"} or tag == "header" and not self.inside:
            return True
        a = {k: v or "" for k, v in attrs}
        return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("role", "").lower() in _ROLES - {"form"}

    def _soft(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """A form, or an element with a marked class or id: silent unless it wraps the page."""
        if tag in ("html", "body", "article", "main"):
            return False
        a = {k: v or "" for k, v in attrs}
        marks = _MARKS if self.inside else _MARKS | _ONLY_OUTSIDE
        return tag == "form" or a.get("role", "").lower() == "form" or _marked(a.get("class", ""), marks) or _marked(a.get("id", ""), marks)

    def _flush(self) -> None:
        if self.text:
            self.blocks.append((self.text, max(self.tags, 1), tuple(n for _, n, *_ in self.open)))
        self.text, self.tags = [], 0

    def _close(self, at: int) -> None:
        names = [name for name, *_ in self.open[at:]]
        if not _BLOCK.isdisjoint(names):
            self._flush()
        self.inside -= sum(name in ("article", "main") for name in names)
        self.links -= names.count("a")
        del self.open[at:]

    def _end_head(self) -> None:
        for at, (name, *_) in enumerate(self.open):
            if name == "head" and not any(n in ("template", "noscript") for n, *_ in self.open[at:]):
                self._close(at)
                return

    def handle_starttag(self, tag, attrs):
        if tag not in _IN_HEAD:
            self._end_head()
        if tag in _BLOCK:
            for at in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph, an item the item before
                name = self.open[at][0]
                if name == "p" or name in _ENDS.get(tag, ()):
                    self._close(at)
                    break
                if name in _SCOPES:
                    break
            self._flush()
        self.tags += 1
        if tag == "br":
            self.text.append(("\n", -1, False))
        if tag in _VOID:
            return
        soft = self.open[-1][3] if self.open else -1
        silent = bool(self.open and self.open[-1][2]) or self._silent(tag, attrs)
        if not silent and tag in ("article", "main"):
            n = soft
            while n >= 0 and not self.holds[n]:
                self.holds[n] = True
                n = self.outer[n]
        if not silent and self._soft(tag, attrs):
            self.outer[len(self.names)], soft = soft, len(self.names)
            self.size[soft], self.holds[soft] = 0, False
        self.inside += tag in ("article", "main")
        self.links += tag == "a"
        self.open.append((tag, len(self.names), silent, soft))
        self.names.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open and self.open[-1][0] == tag and tag not in ("p", "div", "section", "article"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if not (self.open and self.open[-1][2]):
            soft, n = self.open[-1][3] if self.open else -1, len(data.strip())
            self.text.append((data, soft, self.links > 0))
            self.size[soft] += n
            if n and self.inside:
                self.in_article[soft] = True

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over the lines beside each; at the ends only over lines that are there."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return np.convolve(ratios, kernel)[RADIUS:-RADIUS] / np.convolve(np.ones(len(ratios)), kernel)[RADIUS:-RADIUS]


def _heard(parser: _Lines) -> set[int]:
    """The soft elements that are not silent, and -1.

    One by one, those that wrap the page speak: with nearly all of its text, or with its only article or main element.
    Texts are heard when all soft elements around them speak.
    """
    total = dict.fromkeys(parser.outer, 0)
    for n in sorted(parser.outer, reverse=True):  # inner ones have the larger numbers
        total[n] += parser.size[n]
        if parser.outer[n] >= 0:
            total[parser.outer[n]] += total[n]
    heard, loud, article, speak = {-1}, parser.size[-1], parser.in_article.get(-1, False), set()
    silent = dict(sorted(total.items(), key=lambda x: (not parser.holds[x[0]], -x[1], x[0])))
    while silent and not article:
        n = next(iter(silent))
        if not silent[n] or not (parser.holds[n] or silent[n] >= _WRAPPER * (loud + silent[n])):
            break
        del silent[n]
        speak.add(n)
        if parser.outer[n] in heard:
            fresh = [n]
            while fresh:  # with n, those within it that spoke before
                k = fresh.pop()
                heard.add(k)
                loud, article = loud + parser.size[k], article or parser.in_article.get(k, False)
                fresh += [x for x in speak - heard if parser.outer[x] == k]
    return heard


def _lines(html: str) -> tuple[_Lines, list[tuple[str, int, tuple[int, ...], int]]]:
    """The parser, and text, tags, path and characters in links of every block with text that is heard."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._close(0)
    parser._flush()
    heard, out = _heard(parser), []
    for texts, tags, path in parser.blocks:
        texts = [x for x in texts if x[1] in heard]
        if text := " ".join("".join([x for x, *_ in texts]).split()):
            out.append((text, tags, path, min(sum(len(x.strip()) for x, _, link in texts if link), len(text))))
    return parser, out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by single spaces; empty if there are none."""
    parser, lines = _lines(html or "")
    if not lines:
        return ""
    ratio = smoothed(np.array([(len(t) - linked) / n for t, n, _, linked in lines]))
    content = ratio >= min(ratio.std(), ratio.mean())
    # top-level articles with content, else main elements, else the smallest element that holds all content
    paths = [line[2] for line, chosen in zip(lines, content, strict=True) if chosen]
    for name in ("article", "main"):
        if region := {n for path in paths for n in [next((n for n in path if parser.names[n] == name), None)] if n is not None}:
            break
    else:
        shared = [n for n in commonprefix(paths) if parser.names[n] in _HOLDERS]
        region = set(shared[-1:])
    kept = [(t, path) for (t, _, path, linked), chosen in zip(lines, content, strict=True) if chosen or linked < LINKED * len(t)]
    return " ".join(t for t, path in kept if not region or not region.isdisjoint(path))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    Returns page_id, url, text, n_chars (code points); one row per input row, whatever else pages holds. A null or
    empty html, or one without text outside silent elements, gives the empty text. Null ids and urls stay null,
    repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
